"""Fixed values.

Everything in this file is data that results depend on: word lists, character
tables, thresholds and page geometry.  The values are fixed by the forms and the
rules being reproduced; none of them is tuned here.
"""

# --- fixed values: output fields -------------------------------------------
PRIMARY_FIELDS = ["full_name", "dob", "gender", "father_name", "location", "address_details"]
METADATA_FIELDS = ["confidence_metrics", "raw_extracted_text"]
OUTPUT_FIELDS = PRIMARY_FIELDS + METADATA_FIELDS
ENGINE_FIELDS = ["name", "dob", "gender", "father_name", "address", "state", "pin"]
PUBLIC_ENGINE_FIELDS = {
    "full_name": ["name"],
    "dob": ["dob"],
    "gender": ["gender"],
    "father_name": ["father_name"],
    "location": ["state", "pin"],
    "address_details": ["address"],
}
REQUIRED_ENGINE_FIELDS = {
    "full_name": ["name"],
    "dob": ["dob"],
    "gender": ["gender"],
    "father_name": ["father_name"],
    "location": ["state", "pin"],
    "address_details": ["address", "state", "pin", "name", "father_name"],
}
NAME_FIELDS = ["name", "father_name"]

# --- fixed values: upload rules ---------------------------------------------
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
ALLOWED_MIME_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp"]

# --- fixed values: states and union territories -----------------------------
STATES = [
    "ANDAMAN AND NICOBAR ISLANDS", "ANDHRA PRADESH", "ARUNACHAL PRADESH", "ASSAM", "BIHAR",
    "CHANDIGARH", "CHHATTISGARH", "DADRA AND NAGAR HAVELI AND DAMAN AND DIU", "DELHI", "GOA",
    "GUJARAT", "HARYANA", "HIMACHAL PRADESH", "JAMMU AND KASHMIR", "JHARKHAND", "KARNATAKA",
    "KERALA", "LADAKH", "LAKSHADWEEP", "MADHYA PRADESH", "MAHARASHTRA", "MANIPUR", "MEGHALAYA",
    "MIZORAM", "NAGALAND", "ODISHA", "PUDUCHERRY", "PUNJAB", "RAJASTHAN", "SIKKIM", "TAMIL NADU",
    "TELANGANA", "TRIPURA", "UTTAR PRADESH", "UTTARAKHAND", "WEST BENGAL",
]
STATE_MIN_RATIO = 0.78

# --- fixed values: printed label words and noise words ----------------------
PRINTED_LABEL_WORDS = [
    "SITC", "SRCT", "KAMERI", "MRE", "INSIVIAUAL", "APPICACIE", "WARNEE", "SHOULD", "FILL",
    "FATHER", "NAME", "ONLY", "PLEASE", "TICK", "APPLICABTE", "DAY", "MONET", "YEAR", "MONTH",
]
ADDRESS_NOISE_WORDS = ["PINZODE", "ZCR", "CODE", "COURRIRY", "NOME", "INDIA", "INOIA"]
RELATION_TOKENS = ["SO", "S0", "C0", "CO", "WO", "D0", "DO"]
RELATION_PREFIXES = ["S/O", "C/O", "W/O", "D/O"]
HOLDER_NOISE_WORDS = [
    "GOVERNMENT", "GOVERNMEN", "GOVT", "INDIA", "UNIQUE", "IDENTIFICATION", "AUTHORITY",
    "MALE", "FEMALE", "DOB", "YEAR", "BIRTH",
]

# --- fixed values: character tables (from, to) -------------------------------
DIGIT_TO_LETTER = ("012568", "OIZSGB")
LETTER_TO_DIGIT = ("OQDILTJ|!:;ZSBGYV/", "000111111112586777")
PIN_STRONG = ("OQDSZBG", "0005286")
PIN_WEAK = ("OQDSZBGILTJ|!", "0005286111111")
PIN_SEPARATORS = "IL|!"
ANCHOR_LETTERS = ("01568$", "OISGBS")
BOX_DIGIT_WEIGHTS = {
    "O": {"0": 1.0},
    "Q": {"0": 0.6, "9": 1.0},
    "D": {"0": 1.0},
    "I": {"1": 1.0},
    "L": {"1": 1.0},
    "T": {"1": 1.0},
    "J": {"1": 1.0},
    "|": {"1": 1.0},
    "!": {"1": 1.0},
    ":": {"1": 1.0},
    ";": {"1": 1.0},
    "Z": {"2": 1.0},
    "S": {"5": 1.0},
    "B": {"8": 1.0},
    "G": {"6": 1.0},
    "Y": {"7": 1.0, "4": 0.7},
    "V": {"7": 0.8, "4": 0.5},
    "X": {"4": 1.0},
}

# --- fixed values: page geometry (fractions of the page or of a crop) --------
PAGE_WIDTH = 1600
PAGE_HEIGHT = 2200
DEFAULT_ROIS = {
    "name": [0.32, 0.275, 0.95, 0.320],
    "dob": [0.05, 0.545, 0.40, 0.578],
    "gender": [0.30, 0.470, 0.85, 0.510],
    "father_name": [0.32, 0.615, 0.95, 0.660],
    "address": [0.28, 0.810, 0.98, 0.940],
    "state": [0.07, 0.940, 0.40, 0.970],
    "pin": [0.41, 0.950, 0.57, 0.973],
}
FIELD_ORDER = ["name", "gender", "dob", "father_name", "address", "state", "pin"]
GENDER_LABELS = {
    "MALE": "Male",
    "-MALE": "Male",
    "FANALE": "Female",
    "FEMALE": "Female",
    "TRONOGENIAR": "Transgender",
    "TRONOGENFAR": "Transgender",
    "TRANSGENDER": "Transgender",
}
GENDER_WINDOWS = {
    "Male": [0.10, 0.66, 0.14, 0.98],
    "Female": [0.29, 0.66, 0.33, 0.98],
    "Transgender": [0.49, 0.66, 0.53, 0.98],
}
DOB_SEGMENT_WINDOWS = {
    "day": [0.08, 0.20, 0.24, 0.84],
    "month": [0.28, 0.20, 0.44, 0.84],
    "year": [0.49, 0.20, 0.79, 0.84],
}
ADDRESS_LINE_WINDOWS = [
    [0.06, 0.20, 0.72, 0.36],
    [0.06, 0.34, 0.72, 0.50],
    [0.06, 0.48, 0.72, 0.64],
    [0.06, 0.62, 0.72, 0.78],
    [0.06, 0.76, 0.72, 0.93],
]
DOB_FIXED_BOXES = [
    [52, 18, 37, 37], [90, 18, 37, 37], [166, 18, 36, 37], [203, 18, 38, 37],
    [279, 18, 38, 37], [318, 18, 37, 37], [355, 18, 37, 37], [392, 17, 40, 38],
]
DOB_FIXED_MIN_WIDTH = 430
DOB_FIXED_MIN_HEIGHT = 55

# --- fixed values: layout anchors ---------------------------------------------
ANCHORS = {
    "name": {
        "phrases": ["LAST NAME SURNAME"],
        "expected_y": 0.298, "threshold": 0.82, "tolerance": 0.07,
        "max_x_pct": 0.30, "max_tokens": 5,
    },
    "gender": {
        "phrases": ["GENDER"],
        "expected_y": 0.490, "threshold": 0.84, "tolerance": 0.06,
        "max_x_pct": 0.35, "max_tokens": 3,
    },
    "dob": {
        "phrases": ["DATE OF BIRTH"],
        "expected_y": 0.545, "threshold": 0.74, "tolerance": 0.07,
        "max_x_pct": 0.40, "max_tokens": 8,
    },
    "father_name": {
        "phrases": ["LAST NAME SURNAME"],
        "expected_y": 0.632, "threshold": 0.82, "tolerance": 0.08,
        "max_x_pct": 0.30, "max_tokens": 5,
    },
    "address": {
        "phrases": ["RESIDENCE ADDRESS", "ADDRESS"],
        "expected_y": 0.804, "threshold": 0.80, "tolerance": 0.06,
        "max_x_pct": 0.35, "max_tokens": 4,
    },
    "state_pin": {
        "phrases": ["STATE UNION TERRITORY", "PINCODE ZIP CODE", "PIN CODE ZIP CODE"],
        "expected_y": 0.954, "threshold": 0.76, "tolerance": 0.04,
        "max_x_pct": 0.65, "max_tokens": 10,
    },
}
CORE_ANCHORS = ["gender", "dob", "address", "state_pin"]
PHRASE_RATIO_WEIGHT = 0.6
PHRASE_CLOSE_WEIGHT = 0.4
PHRASE_CLOSE_RATIO = 0.78
PHRASE_SURPLUS_COST = 0.08
PHRASE_SURPLUS_FLOOR = 0.55
ANCHOR_TEXT_SHARE = 0.84
ANCHOR_PLACE_SHARE = 0.16
FIT_SCALES = [0.94, 1.06]
FIT_WORST = 0.018

# --- fixed values: refinement --------------------------------------------------
REFINE_MIN_CONFIDENCE = {
    "name": 0.90, "father_name": 0.90, "dob": 0.86, "address": 0.82, "state": 0.84, "pin": 0.86,
}
FIELD_LABELS = {
    "name": ["LAST", "FIRST", "MIDDLE", "NAME", "SURNAME", "FULL"],
    "father_name": ["LAST", "FIRST", "MIDDLE", "NAME", "SURNAME", "FATHER"],
    "dob": ["DATE", "BIRTH", "DAY", "MONTH", "YEAR"],
    "address": [
        "ADDRESS", "RESIDENCE", "STATE", "PINCODE", "ZIP", "COUNTRY", "VILLAGE", "TOWN", "CITY",
        "DISTRICT",
    ],
    "state": ["STATE", "UNION", "TERRITORY"],
    "pin": ["PINCODE", "ZIP", "CODE"],
}
# field -> expand_x, expand_y, shrink_x, shrink_y
FIELD_PADDING = {
    "name": [0.06, 0.14, 0.05, 0.10],
    "father_name": [0.06, 0.14, 0.05, 0.10],
    "dob": [0.05, 0.18, 0.04, 0.10],
    "address": [0.03, 0.07, 0.03, 0.06],
    "state": [0.05, 0.16, 0.04, 0.10],
    "pin": [0.06, 0.18, 0.04, 0.10],
}
LEAKAGE_TOKEN_RATIO = 0.84
LEAKAGE_LIMIT = 0.18
RESULT_BONUS = 0.18
REVIEW_CONFIDENCE = 0.90

# --- fixed values: cheque rules and known-name repair ----------------------------
PAN_MIN_SCORE = 80
CHEQUE_MIN_SCORE = 75
PAYEE_MIN_SCORE = 75
ACCOUNT_NUMBER_LENGTH = 20
KNOWN_NAME_MIN_RATIO = 0.72
