"""Fixed values of the annotated-dataset model: columns, vocabularies, thresholds. They are data formats, not choices."""

from __future__ import annotations

from pyspark.sql import types as T

# The annotation table.
META_COLUMNS = (
    "image", "plate_num", "plate_type", "bbox_x", "bbox_y", "bbox_w", "bbox_h",
    "quad_x1", "quad_y1", "quad_x2", "quad_y2", "quad_x3", "quad_y3", "quad_x4", "quad_y4",
    "is_vehicle", "is_synthetic", "source", "license", "conditions",
)
BBOX_COLUMNS = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")
QUAD_COLUMNS = ("quad_x1", "quad_y1", "quad_x2", "quad_y2", "quad_x3", "quad_y3", "quad_x4", "quad_y4")
BOOLEAN_COLUMNS = ("is_vehicle", "is_synthetic")
PROVENANCE_COLUMNS = ("source", "license")
PLATE_TYPES = ("other", "type1", "type1a", "type1b")
TEXT_TYPES = ("type1", "type1a", "type1b")
CONDITIONS = ("day", "night", "rain", "snow", "dirt", "glare", "motion_blur", "angle")
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
REAL_PREFIX, SYNTHETIC_PREFIX = "images/real/", "images/synthetic/"
HIDDEN = "#"
QUAD_TOLERANCE = 0.25

#: What parts words: the white space of Unicode and the four ASCII separators.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Licences.
DATASET_LICENSE = "CC BY 4.0"
REDISTRIBUTABLE = ("own work", "public domain", "cc0", "cc0 1.0", "cc by 1.0", "cc by 2.0", "cc by 2.5", "cc by 3.0", "cc by 4.0")
BARRED_TOKENS = {
    "nc": "non-commercial",
    "noncommercial": "non-commercial",
    "nd": "no-derivatives",
    "noderivatives": "no-derivatives",
    "noderivs": "no-derivatives",
    "sa": "share-alike",
    "sharealike": "share-alike",
    "gfdl": "copyleft (GNU Free Documentation License)",
    "gpl": "copyleft (GNU General Public License)",
    "lgpl": "copyleft (GNU Lesser General Public License)",
    "fal": "copyleft (Free Art License)",
}
LICENSE_ALIASES = {
    "cc0": "cc0",
    "cc01.0": "cc0",
    "cc010": "cc0",
    "publicdomain": "public domain",
    "pd": "public domain",
    "norestrictions": "public domain",
}
NO_CREDIT_NEEDED = ("cc0", "cc0 1.0", "public domain", "own work")

# Plate grammar.
PLATE_LETTERS = "ABCEHKMOPTXY"
CYRILLIC, LATIN = "АВЕКМНОРСТУХ", "ABEKMHOPCTYX"
LONG_REGION_STARTS = "127"

# Splits.
REAL_SPLITS = ("train", "val", "holdout")
REAL_WEIGHTS = {"train": 0.70, "val": 0.15, "holdout": 0.15}
SYNTHETIC_SPLITS = ("train", "val", "test")
SYNTHETIC_WEIGHTS = {"train": 0.85, "val": 0.10, "test": 0.05}
SPLIT_SEED = 2026092201
SMALL_HOLDOUT = 30

# Source records and candidates.
RECORD_FIELDS = (
    "source_id", "source_name", "source_reference", "original_creator", "upstream_source", "stated_license",
    "license_evidence_url", "redistribution_allowed", "modification_allowed", "commercial_use_allowed",
    "attribution_required", "attribution_text", "provenance_evidence", "privacy_review", "decision", "decided_by",
    "date_checked", "notes",
)
PERMISSIONS = ("yes", "no", "unclear")
PERMISSION_FIELDS = ("redistribution_allowed", "modification_allowed", "commercial_use_allowed")
PRIVACY_STATES = ("not_started", "in_progress", "completed", "not_required")
PRIVACY_ACTIONS = ("none_needed", "blurred", "covered", "rejected")
SOURCE_DECISIONS = ("PENDING", "ACCEPT_FOR_SUBMISSION", "TRAINING_ONLY_IF_LEGAL", "REFERENCE_ONLY", "REJECT")
ACCEPT = "ACCEPT_FOR_SUBMISSION"
CANDIDATE_FIELDS = (
    "candidate_id", "source_platform", "original_url", "file_page_url", "creator", "license", "license_url",
    "attribution", "redistribution_status", "modification_status", "plate_class", "class_confidence", "is_real_photo",
    "full_scene_or_crop", "resolution", "source_group", "provenance_status", "decision", "notes",
)
CANDIDATE_CLASSES = ("CONFIRMED_TYPE1A", "CONFIRMED_TYPE1B", "CONFIRMED_TYPE1", "OTHER", "AMBIGUOUS", "REJECT")
CONFIRMED_CLASSES = ("CONFIRMED_TYPE1A", "CONFIRMED_TYPE1B", "CONFIRMED_TYPE1", "OTHER")
PROVENANCE_STATES = ("VERIFIED_ON_SOURCE", "PLATFORM_METADATA_ONLY", "UNRESOLVED", "UNKNOWN")
IMAGE_MEDIA = ("image/jpeg", "image/png")

# Metrics.
WILSON_Z = 1.96
IOU_LADDER = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
NEAR_DUPLICATE = 0.97

SPLIT_MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("image", "group", "split", "source", "assigned_on", "note")])
SYNTHETIC_MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("image", "split", "plate_type", "difficulty", "stratum")])
CANDIDATE_MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in CANDIDATE_FIELDS])
META = T.StructType([T.StructField(c, T.StringType()) for c in META_COLUMNS])

# Review flags, reasons and limits.
REVIEW_FLAGS = {
    "renamed": "extension_mismatch",
    "unreadable": "unreadable_image",
    "empty": "no_annotation",
    "several": "multiple_plates",
    "wide": "one_line_shape",
    "square": "square_or_two_line_candidate",
    "between": "ambiguous_shape",
    "tiny": "tiny_plate",
    "small": "small_plate",
    "edge": "plate_touches_edge",
}
WIDE_ASPECT, SQUARE_ASPECT = 3.2, 2.4
TINY_WIDTH, SMALL_WIDTH = 30.0, 80.0
ABSTAIN, PENDING = "needs_human_review", "pending"
REASON_YELLOW, REASON_MOST_YELLOW = "yellow_plate_colour", "most_yellow_in_dataset"
YELLOW_SHORTLIST = 40
STRONG_YELLOWNESS = 45.0
NEUTRAL_CHROMA = 128.0
INNER_SHARE, RING_SCALE = 0.8, 2.2

# Condition tags by measured strength.
ANGLE_DEGREES, BLUR_PIXELS, DIRT_STRENGTH = 15.0, 3.0, 0.25

# Discovery.
LEAST_SIDE = 400
ORIGINALS = "originals"

# Dataset plans. Severities and budgets are hundredths; effects stand in pipeline order.
CLASS_WEIGHTS = {"type1": 0.20, "type1a": 0.40, "type1b": 0.40}
LEVEL_WEIGHTS = {"easy": 0.35, "medium": 0.45, "hard": 0.20}
LONG_REGION_SHARE = 0.35
EFFECT_SEVERITY = {
    "night": 150, "low_light": 100, "shadow": 50, "glare": 100, "dirt": 75, "occlusion": 100,
    "rain": 75, "snow": 75, "motion_blur": 125, "defocus": 125, "heavy_noise": 100,
}
EXCLUSIVE_EFFECTS = (("night", "low_light"), ("rain", "snow"), ("motion_blur", "defocus"))
EFFECT_LEVELS = {
    "easy": {"most": 1, "budget": 125, "chance": {
        "night": 0.10, "low_light": 0.05, "shadow": 0.15, "glare": 0.10, "dirt": 0.12, "occlusion": 0.0,
        "rain": 0.06, "snow": 0.07, "motion_blur": 0.15, "defocus": 0.08, "heavy_noise": 0.0,
    }},
    "medium": {"most": 2, "budget": 200, "chance": {
        "night": 0.50, "low_light": 0.12, "shadow": 0.30, "glare": 0.28, "dirt": 0.38, "occlusion": 0.06,
        "rain": 0.16, "snow": 0.19, "motion_blur": 0.34, "defocus": 0.18, "heavy_noise": 0.08,
    }},
    "hard": {"most": 3, "budget": 275, "chance": {
        "night": 0.55, "low_light": 0.20, "shadow": 0.35, "glare": 0.32, "dirt": 0.45, "occlusion": 0.12,
        "rain": 0.18, "snow": 0.20, "motion_blur": 0.38, "defocus": 0.25, "heavy_noise": 0.20,
    }},
}

# Bounds of a generator's settings as (kind, least, most, most itself not allowed).
GENERATOR_SETTINGS = {
    "seed": ("whole", 0, None, False),
    "count": ("whole", 1, None, False),
    "three_digit_region_probability": ("number", 0.0, 1.0, False),
    "max_hidden_characters": ("whole", 0, 4, False),
    "max_images_per_plate": ("whole", 1, None, False),
    "supersample": ("whole", 1, 8, False),
    "min_char_height_px": ("number", 2, 100, False),
}
LEVEL_SETTINGS = {
    "px_per_mm": ("pair", 0.02, 5.0, False),
    "max_yaw_deg": ("number", 0.0, 70.0, False),
    "max_pitch_deg": ("number", 0.0, 70.0, False),
    "max_roll_deg": ("number", 0.0, 70.0, False),
    "distance_ratio": ("pair", 2.0, 200.0, False),
    "brightness": ("pair", 0.1, 3.0, False),
    "contrast": ("pair", 0.1, 3.0, False),
    "gamma": ("pair", 0.2, 5.0, False),
    "white_balance": ("number", 0.0, 0.5, False),
    "noise_sigma": ("pair", 0.0, 0.5, False),
    "jpeg_quality": ("pair", 5, 100, False),
    "double_jpeg_probability": ("number", 0.0, 1.0, False),
    "max_effects": ("whole", 0, None, False),
    "severity_budget": ("number", 0.0, 20.0, False),
    "min_plate_contrast": ("number", 0.0, 1.0, True),
}
EFFECT_RANGES = {
    "night": ("darkness", "plate_gain"), "low_light": ("gain",), "shadow": ("strength",), "glare": ("strength", "radius"), "dirt": ("strength",),
    "occlusion": ("extent",), "rain": ("density",), "snow": ("density",), "motion_blur": ("length_px",), "defocus": ("radius_px",), "heavy_noise": ("sigma",),
}

# Views of a level (largest turns in degrees, pixels a millimetre, distance in widths), image sizes, plate sizes in millimetres.
LEVEL_VIEWS = {
    "easy": {"yaw": (-12, 12), "pitch": (-8, 8), "roll": (-4, 4), "px_per_mm": (0.30, 0.60), "distance_ratio": (8.0, 20.0)},
    "medium": {"yaw": (-30, 30), "pitch": (-15, 15), "roll": (-8, 8), "px_per_mm": (0.18, 0.40), "distance_ratio": (5.0, 15.0)},
    "hard": {"yaw": (-45, 45), "pitch": (-22, 22), "roll": (-12, 12), "px_per_mm": (0.14, 0.28), "distance_ratio": (4.0, 12.0)},
}
IMAGE_SIZES = ((640, 480), (800, 600), (1024, 768), (1280, 720))
PLATE_SIZES = {"type1": (520, 112), "type1a": (290, 170), "type1b": (520, 112)}
