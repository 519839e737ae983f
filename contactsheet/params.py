"""Fixed values that define behaviour; every operator takes them as parameters with these defaults."""

from __future__ import annotations

# Tag scores.
TAG_STORED, TAG_FILTER, TAG_STRONG, TAG_USER, TAG_REMOVED = 1.5, 2.0, 2.5, 10.0, -1.0
TAGS_PER_PHOTO = 12

# Duplicates.
PHASH_NEAR, DHASH_NEAR, PHASH_LIKELY = 6, 10, 16
SEM_NEAR, SEM_LIKELY, SEM_SIMILAR, SEM_SYNTHETIC = 0.985, 0.955, 0.93, 0.995
PHASH_SYNTHETIC, DHASH_SYNTHETIC, BURST_SECONDS, MAX_BUCKET = 2, 4, 180.0, 400
# The reference skips buckets of more than MAX_BUCKET rows; here that is an option. Hashes of a bucket that meet in one cell.
BAND_CELL = 1000
KIND_RANK = {"exact": 3, "near": 2, "likely": 1, "similar": 0}
ORIGIN_RANK = {"camera": 4, "phone": 4, "scan": 3, "edited": 2, "download": 1, "whatsapp": 0, "screenshot": -1}

# Events and trips (hours, minutes, kilometres).
GAP_HOURS, TRAVEL_GAP_MINUTES, TRAVEL_KM, MIN_GAP_MINUTES = 2.5, 45.0, 30.0, 20.0
OVERNIGHT_HOURS, SAME_DAY_HOURS, MULTIDAY_HOURS, MAX_EVENT_PHOTOS = 6.0, 10.0, 20.0, 1200
TRIP_KM, TRIP_GAP_DAYS, TRIP_DAYS = 60.0, 2.0, 0.75

# How near two segments of one city are (kilometres).
SAME_CITY_KM = 15.0

# The categories' density rules.
CATEGORY_DENSITY, CATEGORY_SHARE, CATEGORY_DOMINANCE = 0.25, 0.08, 1.6

# Bursts, live pairs, as-of joins.
STACK_GAP, STACK_PHASH, STACK_COSINE = 1.5, 18, 0.93
LIVE_SECONDS, LIVE_SKEW, ASOF_SECONDS, TRACK_SECONDS = 5.0, 120.0, 1200.0, 300.0

# Clustering.
FACE_QUALITY, FACE_SCORE, FACE_SIZE = 0.35, 0.60, 40.0
CLUSTER_K, CLUSTER_EDGE, CLUSTER_ROUNDS, CLUSTER_MIN, ATTACH, ATTACH_MARGIN = 24, 0.42, 12, 3, 0.50, 0.04

MERGE, MERGE_GATE, MERGE_MEDIAN = 0.68, 0.12, 0.50

# Visual search.
VISUAL_SIGMA, VISUAL_HEAD, VISUAL_MIN, VISUAL_MAX, DIVERSIFY, DIVERSIFY_LAST = 1.6, 0.60, 40, 800, 0.93, 40

EARTH_KM = 6371.0088

# How much likelier an administrative seat is the name a person would use.
SEAT_BONUS = {"PPLC": 0.7, "PPLA": 0.5, "PPLA2": 0.35, "PPLA3": 0.2, "PPLA4": 0.1}

# Places that are their own rather than a bigger town's: village and edge of a town's reach (people, kilometres).
VILLAGE_KM, VILLAGE_TOWN, EDGE_PEOPLE, EDGE_SHARE, EDGE_TOWN = 3.0, 20_000, 3_000, 0.75, 300_000

# Quality (log10 of sharpness from and to, brightness aimed at, contrast and clipping that count in full, megapixels
# from and to) and the weights of sharpness, exposure, resolution, aesthetics and the best face.
SHARP_FROM, SHARP_TO, BRIGHTNESS, FULL_CONTRAST, FULL_CLIPPING, MEGAPIXELS_FROM, MEGAPIXELS_TO = 1.2, 2.9, 0.47, 0.22, 0.35, 0.3, 12.0
WEIGHT_SHARP, WEIGHT_EXPOSED, WEIGHT_FINE, WEIGHT_AESTHETIC, WEIGHT_FACE = 0.35, 0.2, 0.1, 0.25, 0.10

# First year of a plausible date.
MIN_YEAR = 1985

# File name patterns, in order, with what they give and the kind of source they tell.
FILENAME_PATTERNS = (
    (r"(?i)(?:IMG|VID|PTT|STK)-(\d{4})(\d{2})(\d{2})-WA\d+", "date", "whatsapp"),
    (r"(?i)WhatsApp Image (\d{4})-(\d{2})-(\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2})(?:\s*([AP]M))?", "datetime", "whatsapp"),
    (r"(?i)Screen ?[Ss]hot (\d{4})-(\d{2})-(\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2})(?:\s*([AP]M))?", "datetime", "screenshot"),
    (r"(?i)Screenshot[_-](\d{4})-?(\d{2})-?(\d{2})[-_](\d{2})-?(\d{2})-?(\d{2})", "datetime", "screenshot"),
    (r"(?i)photo_(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})", "datetime", "download"),
    (r"(?i)signal-(\d{4})-(\d{2})-(\d{2})-(\d{2})(\d{2})(\d{2})", "datetime", "download"),
    (r"(?:^|[^0-9])(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})", "datetime", "phone"),
    (r"(\d{4})-(\d{2})-(\d{2})[ _](\d{2})\.(\d{2})\.(\d{2})", "datetime", "phone"),
    (r"(\d{4})-(\d{2})-(\d{2})[T_ -](\d{2})[-:.](\d{2})[-:.](\d{2})", "datetime", None),
    (r"(?:FB_IMG_|received_|^)(1[2-9]\d{11})(?:\D|$)", "epoch_ms", "download"),
    (r"(?:^|[^0-9])(\d{4})-(\d{2})-(\d{2})(?:[^0-9]|$)", "date", None),
    (r"(?:^|[^0-9])((?:19|20)\d{2})(\d{2})(\d{2})(?:[^0-9]|$)", "date", None),
)

# Folder name patterns: a day, a named month, a numbered month, a year.
FOLDER_DAY = r"(?:^|[^0-9])((?:19|20)\d{2})[-_. ]?(\d{2})[-_. ]?(\d{2})(?:[^0-9]|$)"
FOLDER_NAMED_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s_,.-]*((?:19|20)\d{2})\b"
FOLDER_MONTH = r"(?:^|[^0-9])((?:19|20)\d{2})[-_. /](\d{1,2})(?:[^0-9]|$)"
FOLDER_YEAR = r"(?:^|[^0-9])((?:19|20)\d{2})(?:[^0-9]|$)"

# Makers, editors, folders and screens that tell where a picture comes from.
PHONE_MAKES = (
    "apple", "samsung", "xiaomi", "redmi", "poco", "google", "oneplus", "oppo", "vivo", "realme",
    "motorola", "huawei", "honor", "nokia", "hmd", "nothing", "lg", "sony mobile", "asus", "lenovo",
    "iqoo", "infinix", "tecno", "micromax", "lava", "htc", "zte", "meizu",
)
EDIT_SOFTWARE = (
    "photoshop", "lightroom", "snapseed", "gimp", "picsart", "vsco", "facetune", "canva", "pixlr",
    "affinity", "capture one", "luminar", "darktable", "rawtherapee", "photos 1", "meitu", "lensa",
    "remini", "b612", "snow", "polarr", "afterlight", "instagram",
)
DOWNLOAD_FOLDERS = ("download", "telegram", "instagram", "facebook", "saved pictures", "pinterest")
SCREEN_WIDTHS = (720, 750, 768, 828, 900, 1080, 1125, 1170, 1179, 1242, 1280, 1284, 1290, 1366, 1440, 1536, 1600, 1920, 2160, 2560, 2880, 3840)
SCREEN_ASPECTS = (16 / 9, 19.5 / 9, 20 / 9, 18 / 9, 16 / 10, 19 / 9, 21 / 9, 3 / 2)

# Endings that editors give to a copy's name.
EDIT_SUFFIXES = ("-edited", "-effects", "-smile", "-mix", "-edytowane", "-bearbeitet", "-bewerkt", "-編集済み", "-modificato", "-modifié", "-ha editado", "-editat")

# Words of folders that hold second copies.
SECONDARY_FOLDER_WORDS = (
    "backup", "back up", "copy", "copies", "duplicate", "archive", "old", "recycle", "trash", "temp", "tmp", "export",
    "compressed", "resized", "whatsapp", "telegram", "downloads", "download", "recovered",
)

# Names of colours and words that mean one of them.
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white", "grey")
COLOUR_WORDS = {
    "gray": "grey", "violet": "purple", "golden": "yellow", "gold": "yellow", "navy": "blue", "cyan": "blue", "teal": "green", "turquoise": "blue",
    "beige": "brown", "tan": "brown", "silver": "grey", "maroon": "red", "crimson": "red", "magenta": "pink", "lime": "green",
}

# Collections (share of the width of a selfie's face, faces of a selfie, sharpness of a blurred picture, bytes of a large file).
SELFIE_WIDTH, SELFIE_FACES, BLURRY, LARGE_BYTES = 0.22, 2, 35.0, 20_971_520
RAW_ENDINGS = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".srw", ".pef", ".nrw")
PET_TAGS, TEXT_TAGS, MEME_TAGS = ("dog", "cat"), ("document", "receipt", "id card", "whiteboard"), ("meme",)
