"""Word lists, patterns and limits the results depend on."""

# Characters removed before a text is read as a number.
NUMBER_DECORATION = [",", "$", "%", "€", "£", " "]

# Words that mark a failed or missing number.
ERROR_WORDS = ["error", "unknown", "n/a", "na", "null", "missing", "none", "#n/a"]

# Cell texts that stand for a missing value.
MISSING_WORDS = ["unknown", "error", "n/a", "na", "null", "none", "missing", "nan", "#n/a", "#error", ""]

# Words read as booleans when a column is converted.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]

# The wider lists used to recognise a boolean column.
TRUE_WORDS_WIDE = ["true", "yes", "1", "t", "y", "on", "enabled", "active"]
FALSE_WORDS_WIDE = ["false", "no", "0", "f", "n", "off", "disabled", "inactive"]

# Date layouts.
DATE_PATTERNS = [
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$",
    r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$",
    r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
]

# Identifier layouts (alphanumeric, digits, code, UUID, phone, e-mail).
IDENTIFIER_PATTERNS = [
    r"^[a-zA-Z0-9]{6,}$",
    r"^\d{5,}$",
    r"^[A-Z]{2,}\d+$",
    r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    r"^\+?\d{7,15}$",
    r"^[\w\.-]+@[\w\.-]+\.\w+$",
]

# Parts of column names that hint at a kind or a role.
NUMERIC_NAME_PARTS = [
    "quantity", "price", "amount", "cost", "total", "value", "sum", "count", "number",
    "int", "float", "score", "rating", "percent", "percentage",
]
TARGET_NAME_PARTS = [
    "target", "label", "class", "outcome", "result", "prediction", "default", "churn", "fraud",
    "risk", "score", "rating", "price", "value", "amount", "cost", "revenue", "sales", "profit",
    "loss", "duration", "time", "age",
]
METADATA_NAME_PARTS = [
    "date", "time", "created", "updated", "modified", "timestamp", "name", "description",
    "comment", "note", "address", "city", "country",
]
IDENTIFIER_NAME_PARTS = [
    "id", "key", "uuid", "guid", "identifier", "code", "ref", "index", "name", "fullname",
    "firstname", "lastname", "user", "phone", "mobile", "contact", "email", "mail", "ssn",
    "passport", "account", "serial", "number", "customer", "client",
]

# Words and weights for scoring target columns.
TARGET_SCORE_WORDS = ["target", "label", "class", "outcome", "result"]
ID_SCORE_WORDS = ["id", "key", "index", "number", "code", "ref"]

# Unicode white space, as a trim set.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
