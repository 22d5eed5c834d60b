"""They must equal the published ones for results to agree."""

# Genre vocabulary, in sorted order.
GENRES = [
    "acoustic", "alternative", "ambient", "anime", "blues", "chill", "classical", "country",
    "dance", "edm", "electronic", "folk", "funk", "gospel", "hip-hop", "house", "indie",
    "indie-pop", "j-pop", "jazz", "k-pop", "latin", "metal", "pop", "punk", "r-n-b", "reggae",
    "rock", "soul", "synth-pop",
]

# Mood -> (target energy, target valence).
MOODS = {
    "Calm": (0.30, 0.50),
    "Energetic": (0.80, 0.70),
    "Upbeat": (0.60, 0.85),
    "Melancholic": (0.30, 0.20),
    "Intense": (0.85, 0.25),
}

# Characters removed from both ends of a text, as Python's strip() does.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Survey options.
PURPOSES = ["study", "workout", "relax", "commute", "explore"]
EXPLORATION = {"familiar": 0.1, "mixed": 0.5, "discover": 0.9}
POPULARITY_LEVELS = ["mainstream", "mixed", "underground"]

# Inputs of the song embedding.
AUDIO_FEATURES = [
    "energy", "valence", "danceability", "acousticness", "instrumentalness", "speechiness",
    "liveness", "tempo_bpm", "loudness", "popularity_norm",
]
MAX_COMPONENTS = 32

# Ranking features and the weights used when no model is given.
FEATURES = [
    "content_similarity", "artist_similarity", "freshness", "popularity", "collaborative_score",
    "diversity_penalty",
]
FALLBACK_WEIGHTS = {
    "content_similarity": 0.35,
    "collaborative_score": 0.25,
    "artist_similarity": 0.20,
    "freshness": 0.10,
    "popularity": 0.10,
}
FRESHNESS_DECAY = 0.01

# First-run scores.
FAMILIAR_WEIGHTS = (0.5, 0.3, 0.2)  # artist, genre, popularity
DISCOVERY_WEIGHTS = (0.40, 0.35, 0.25)  # genre, mood, popularity
FAVOURITE_MATCH = 1.0
RECENT_MATCH = 0.7

# Candidate pool.
FRESH_WINDOWS = [90, 180, 365, 730]
MIN_FRESH = 50
POOL_SIZE = 200
SIMILAR_ARTISTS = 10

# User embedding blend.
BLEND_BELOW = 5
BEHAVIOUR_WEIGHT = 0.7
SURVEY_WEIGHT = 0.3

# Text index, search and final lists.
MAX_TERMS = 30_000
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: What lies between tokens, and single characters.
TOKEN_GAP = r"[^\p{L}\p{N}_]+"
SEARCH_HITS = 100
RANKED_ROWS = 50
FINAL_ROWS = 10
TOP_ARTISTS = 500
SONG_MATCHES = 20
SUMMARY_GENRES = 3

# Ranker training.
TREES = 200
LEAVES = 31
LEARNING_RATE = 0.05
PATIENCE = 20
SEED = 42
TEST_SHARE = 0.2
