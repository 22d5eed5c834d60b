"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is DataFrame work on one row at a time, without an exchange. Matches are located by wrapping them in a
private mark and cutting the text there: every second part is a match, and its place is the length of the parts before
it, summed in two levels so that a text with very many matches costs little more than its length. Patterns start only
where a run of their first class starts and use possessive loops, so no text makes them slow or deep.

Kinds ``email ip card phone`` are the base: their spans always stay. Further kinds are kept from a score on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import beside, text_of, with_results

MARK, OTHER = "\x01", "\x02"
CHUNK = 256
#: Code points before and after a proposal in which context words count.
NEAR = 40
LEAST_SCORE = 0.6

# Base kinds first, in the order that breaks ties.
KINDS = ["email", "ip", "card", "phone", "iban", "local_phone", "national_id", "secret"]
BASE = 4

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """Numbers of the fixed length of their country, then any other code at up to 34 characters."""
    fixed = [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_LENGTHS.items()]
    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return "|".join([*fixed, rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"])


# The base patterns of the contract, with a possessive loop wherever giving back could not help. An email can only
# match from the start of a run of local-part characters, or from where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ibans()})(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+(.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
}
# A text without these characters holds no match; most texts are ruled out so.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "national_id": r"-[0-9]{2}-",
    "secret": r"AKIA|(?i:passw|token|secret|api.?key|kennwort|contrase|mot de passe)",
}
# Words near a proposal that raise its score.
CONTEXT = {
    "email": "(?i)mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|address|server|host",
    "card": "(?i)card|visa|master|tarjeta|carte|karte|payment",
    "phone": "(?i)tel|phone|call|mobil|fax|llam|appel",
    "iban": "(?i)iban|account|konto|cuenta|compte",
    "local_phone": "(?i)tel|phone|call|mobil|fax|llam|appel",
    "national_id": r"(?i)ssn|social|security|\bid\b|ident",
    "secret": "(?i)passw|token|secret|api.?key|access.?key|kennwort|contrase|mot de passe",
}
# Score of a proposal whose check holds, and what a context word adds.
WORTH = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "local_phone": 0.4, "national_id": 0.4,
         "secret": 0.3}
NEARBY = 0.3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def mod97(match: Column) -> Column:
    """ISO 7064 remainder of an account number: its first four characters go last, letters count from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda rest, c: F.when(c == "", rest).when(c.rlike("[0-9]"), F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97)))
        .otherwise(F.pmod(rest * 100 + F.ascii(c) - 55, F.lit(97))))


def confirmed(kind: str, match: Column) -> Column:
    """Whether the check of a kind holds for a match."""
    if kind == "ip":
        # A part's value, however many zeros it starts with.
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(match) == 1)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def score(kind: str, match: Column, before: Column, after: Column) -> Column:
    near = F.concat(before, F.lit(" "), after).rlike(CONTEXT[kind])
    worth = F.lit(WORTH[kind]) + F.when(near, NEARBY).otherwise(0.0)
    if kind == "secret":
        worth = worth + F.when(match.rlike("^AKIA[A-Z0-9]{16}$"), 0.5).otherwise(0.0)
    return worth


def located(df: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """``_row``, text and ``spans``: array of (start, kind, end, score), by start and kind; code points, end exclusive."""
    clean = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, OTHER)).otherwise(F.col("text"))
    df = df.select("_row", "text", clean.alias("_clean"))
    found = {k: F.when(F.col("_clean").rlike(NEEDS[k]), F.split(
        F.regexp_replace("_clean", PATTERNS[k], f"{MARK}$0{MARK}"), MARK)) for k in kinds}
    df = df.select("_row", "text", *[c.alias(f"_p_{k}") for k, c in found.items()])
    hit = {k: F.size(f"_p_{k}") > 1 for k in kinds}
    df = df.select("*", *[F.when(hit[k], F.transform(f"_p_{k}", F.length)).alias(f"_n_{k}") for k in kinds])
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda a, n: a + n)

    def chunk_totals(lengths: str) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
        return F.transform(chunks, lambda c: total(F.slice(lengths, c * CHUNK + 1, CHUNK)))

    def chunk_starts(totals: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(totals) - 1), lambda c: total(F.slice(totals, 1, c)))

    # The ends of every part are enough for the words near a match.
    df = df.select("*", *[F.when(hit[k], F.transform(f"_p_{k}", lambda p: side(p, F.lit(NEAR)))).alias(f"{name}_{k}")
                          for k in kinds for name, side in (("_t", F.right), ("_h", F.left))])
    df = df.select("*", *[chunk_totals(f"_n_{k}").alias(f"_c_{k}") for k in kinds])
    df = df.select("*", *[chunk_starts(f"_c_{k}").alias(f"_b_{k}") for k in kinds])

    def spans(kind: str) -> Column:
        parts, lengths, bases = f"_p_{kind}", f"_n_{kind}", f"_b_{kind}"

        def span(j: Column) -> Column:
            chunk = F.floor(j / CHUNK).cast("int")
            start = F.get(bases, chunk) + total(F.slice(lengths, chunk * CHUNK + 1, j - chunk * CHUNK))
            match = F.get(parts, j)
            good = confirmed(kind, match)
            # Every second part is a match of two characters or more, so NEAR + 1 parts hold NEAR code points.
            before = F.slice(f"_t_{kind}", F.greatest(j - NEAR - 1, F.lit(0)) + 1, F.least(j, F.lit(NEAR + 1)))
            after = F.slice(f"_h_{kind}", j + 2, F.lit(NEAR + 1))
            worth = score(kind, match, F.right(F.array_join(before, ""), F.lit(NEAR)), F.left(F.array_join(after, ""), F.lit(NEAR)))
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                            (start + F.length(match)).alias("end"), F.when(good, worth).alias("score"))

        every = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)
        least = 0.0 if KINDS.index(kind) < BASE else LEAST_SCORE
        held = F.filter(every, lambda s: s["score"] >= least)
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
        return F.coalesce(F.when(hit[kind], held), empty)

    return df.select("_row", "text", F.sort_array(F.concat(*[spans(k) for k in kinds])).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(df: DataFrame) -> DataFrame:
    """``_row``, text and ``_cut``: overlapping spans as one (start, end, kind), named by the first.

    A span opens a new one if it starts at or after the end of all spans before it; that end comes from the largest ends
    of whole chunks and of the rest of its own chunk, so the work does not grow with the square of the spans.
    """
    none = F.size("spans") == 0
    largest = lambda ends: F.coalesce(F.array_max(ends), F.lit(0))
    df = df.select("_row", "text", "spans", F.transform("spans", lambda s: s["end"]).alias("_ends"))
    chunks = F.sequence(F.lit(0), F.floor((F.size("_ends") - 1) / CHUNK).cast("int"))
    df = df.select("*", F.when(~none, F.transform(chunks, lambda c: largest(F.slice("_ends", c * CHUNK + 1, CHUNK)))).alias("_c"))
    df = df.select("*", F.when(~none, F.transform(
        F.sequence(F.lit(0), F.size("_c")), lambda c: largest(F.slice("_c", F.lit(1), c)))).alias("_b"))

    def reach(j: Column) -> Column:
        chunk = F.floor(j / CHUNK).cast("int")
        return F.greatest(F.get("_b", chunk), largest(F.slice("_ends", chunk * CHUNK + 1, j - chunk * CHUNK)))

    places = F.sequence(F.lit(0), F.size("spans") - 1)
    df = df.select("*", F.when(~none, F.filter(places, lambda j: F.get("spans", j)["start"] >= reach(j))).alias("_first"))
    cut = F.transform("_first", lambda j, i: F.struct(
        F.get("spans", j)["start"].alias("start"),
        reach(F.coalesce(F.get("_first", i + 1), F.size("spans"))).alias("end"), F.get("spans", j)["kind"].alias("kind")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return df.select("_row", "text", F.coalesce(cut, empty).alias("_cut"))


def mask(df: DataFrame) -> DataFrame:
    """``_row`` and ``masked`` from ``_row``, text and spans.

    The text is taken apart chunk of cuts by chunk, and each chunk's part cut by cut.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    df = merged(df)
    none = F.size("_cut") == 0
    before = lambda j: F.when(j == 0, 0).otherwise(F.get("_cut", j - 1)["end"])
    after = lambda c: F.least((c + 1) * CHUNK, F.size("_cut")) - 1
    chunks = F.sequence(F.lit(0), F.floor((F.size("_cut") - 1) / CHUNK).cast("int"))
    parts = F.transform(chunks, lambda c: F.substring(
        "text", before(c * CHUNK) + 1, F.get("_cut", after(c))["end"] - before(c * CHUNK)))
    df = df.select("_row", "text", "_cut", F.when(~none, parts).alias("_parts"))
    pieces = F.transform("_parts", lambda part, c: F.array_join(F.transform(
        F.sequence(c * CHUNK, after(c)),
        lambda j: F.concat(F.substring(part, before(j) - before(c * CHUNK) + 1, F.get("_cut", j)["start"] - before(j)),
                           F.get(names, F.get("_cut", j)["kind"]))), ""))
    tail = F.substring(F.col("text"), F.get("_cut", F.size("_cut") - 1)["end"] + 1, F.length("text"))
    return df.select("_row", F.when(none, F.col("text")).otherwise(
        F.concat(F.array_join(pieces, ""), tail)).alias("masked"))


def personal_data(docs: DataFrame) -> DataFrame:
    """The documents' columns with n_email, n_ip, n_card, n_phone, base (string), all (string) and the spans.

    Null or empty text: no spans. Equal starts: by kind as listed in ``KINDS``. Repeated rows: each alike. Empty table:
    empty result. An input column named like a result is replaced by the result.
    """
    df = located(beside(docs, text=text_of()))

    def of_kind(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    counts = {f"n_{k}": of_kind(i) for i, k in enumerate(KINDS[:BASE])}
    results = counts | {
        "base": joined(F.filter("spans", lambda s: s["kind"] < BASE)), "all": joined(F.col("spans")),
        "spans": F.transform("spans", lambda s: F.struct(
            F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("kind"), s["start"], s["end"], s["score"]))}
    return df.select(*with_results(docs.columns, results))


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars``, where present, follows the text."""
    out = mask(located(beside(docs, text=text_of())))
    changed = {"text": F.when(F.col("_row.text").isNotNull(), F.col("masked"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_row.text").isNotNull(), F.length("masked").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
