"""Fixed values that must equal the reference's for the same results.

They are the defaults of operator parameters; every operator accepts its own
list instead.
"""

# Action verbs, searched in this order in each instruction part.
ACTION_VERBS = ["change", "modify", "replace", "update", "set", "remove", "delete", "add", "insert"]

# Contract fields looked up in the instruction, in this order.
CONTRACT_FIELDS = [
    "effective date", "term", "termination", "governing law", "state",
    "jurisdiction", "payment terms", "client", "provider", "customer",
    "representative", "fee", "price", "pricing", "deliverable", "party", "parties",
    "section", "article", "clause", "paragraph", "agreement", "contract",
]

# Structure markers worth one point each when present in a chunk.
STRUCTURE_MARKERS = [
    "section", "article", "clause", "paragraph",
    "parties", "agreement", "witnesseth", "whereas",
    "term", "termination", "payment", "services", "obligations",
    "governing law", "liability", "indemnification",
]

# Signature words for layout lines (H2) and for rebuilt paragraphs (H8).
LINE_SIGNATURE_WORDS = ["signature", "signed by", "dated", "provider:", "client:"]
PARAGRAPH_SIGNATURE_WORDS = ["signature", "signed by", "dated", "by:", "name:", "title:"]

# Call-error words, tested in this order.
CREDENTIAL_ERRORS = ["UnrecognizedClientException", "InvalidSignatureException"]
CREDENTIAL_PHRASE_LOWER = "security token"
THROTTLE_ERRORS = ["ThrottlingException", "TooManyRequestsException"]
UNAVAILABLE_ERRORS = ["ServiceUnavailable", "InternalServerError"]

# Role words and company suffixes of the entity patterns.
COMPANY_ROLES = ["Company", "Provider", "Client", "Vendor", "Contractor", "Supplier", "Customer"]
COMPANY_SUFFIXES = ["Inc", "LLC", "Ltd", "Corporation", "Corp", "Company", "Co"]

# Sizes and scores.
CHUNK_SIZE = 25000
CHUNK_OVERLAP = 5000
CHUNK_SEPARATORS = ["\n\n", "\n", " ", ""]
MAX_CONCURRENT_CALLS = 5
MAX_OUTPUT_TOKENS = 4000
OUTPUT_TOKEN_PAD = 500
CALL_ATTEMPTS = 3
FIRST_BACKOFF_SEC = 1.0
MIN_RESPONSE_CHARS = 10
SHORT_RESPONSE_SHARE = 0.3
CLIENT_WAIT_LIMIT_SEC = 1800
ALERT_KEEP_SEC = 7 * 24 * 3600
UPLOAD_LIMIT_BYTES = 100 * 1024 * 1024
WARMUP_PERIOD_MIN = 15
IDLE_SHARE = 0.8
QUEUE_DRAIN_LIMIT = 5

QUOTED_BEFORE, QUOTED_AFTER = 100, 200
ACTION_BEFORE, ACTION_AFTER = 100, 200
FIELD_BEFORE, FIELD_AFTER = 50, 200
PARTIAL_BEFORE, PARTIAL_AFTER = 100, 100
MIN_QUOTED_LEN = 3      # kept when longer than this
MIN_PART_LEN = 5        # parts shorter than this are skipped
MIN_PARTIAL_LEN = 5     # two-word partial entities need at least this many characters

SCORE_CONTAINED = 5
SCORE_FIRST_THIRD = 2
SCORE_MIDDLE_THIRD = 1
SCORE_HALF = 2
HALF_MIN_TARGET_LEN = 10
SCORE_MARKER = 1

# Geometry of layout lines (H1/H2).
CENTRE_TOLERANCE = 50.0
CENTRE_WIDTH_SHARE = 0.7
INDENT_X0 = 100.0
BOLD_FLAG = 16

# Progress marks of a job.
PROGRESS_QUEUED, PROGRESS_STARTED, PROGRESS_EXTRACTED, PROGRESS_REVISING = 0, 10, 30, 40
PROGRESS_REVISED, PROGRESS_RENDERED, PROGRESS_DONE = 70, 85, 100
PROGRESS_REVISION_SPAN = 30

# Fixed value: the one letter whose lower case has more code points than itself.
LENGTHENING_LETTER = "\u0130"

# Messages of rejected requests.
REJECT_NO_PART, REJECT_NO_FILE = "No file part", "No file selected"
REJECT_NO_INSTRUCTION, REJECT_TOO_LARGE = "No instruction provided", "File too large"
REJECT_NO_INLINE = "Missing instruction or document content"

# Fixed value: the next keep-warm time of a model that has gone cold.
COLD_NEXT_WARMUP = "Soon (model likely cold)"
