"""Patterns of the maskers and envelopes; fixed values, in the order in which they apply.

Written so that Python's ``re`` and Java's ``(?U)`` regexes read them alike.
"""

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

ESCAPES = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?"
URL = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|rediss|amqps?|ftp|sftp|ssh|s3)://[^\s"'<>()\[\]]+"""
ISO = r"\d{4}-\d{2}-\d{2}[T ]" + _CLOCK + r"(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
NAMED = (
    rf"\b{_DAY} {_MONTH} {{1,2}}\d{{1,2}} {_CLOCK}(?:\.\d+)?(?: [A-Z]{{2,5}})?(?: \d{{4}})?\b"
    rf"|\b{_DAY}, \d{{1,2}} {_MONTH} \d{{4}} {_CLOCK}(?: (?:[A-Z]{{2,5}}|[+-]\d{{4}}))?"
    rf"|\b\d{{1,2}}/{_MONTH}/\d{{4}}:{_CLOCK}(?: [+-]\d{{4}})?"
)
SYSLOG = rf"\b{_MONTH}\s+\d{{1,2}}\s+{_CLOCK}\b"
SLASH = r"\b\d{1,2}/\d{1,2}/\d{4}[ T]" + _CLOCK + r"(?:[.,]\d+)?\b"
EPOCH = r"\b1[0-9]{9}(?:[0-9]{3})?\b"
CLOCK = r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b(?::\d{{1,5}})?"
IPV6 = r"\[[0-9a-fA-F]*:[0-9a-fA-F:]*\](?::\d{1,5})?|\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?:%[0-9a-zA-Z]+)?\b"
TEMP = r"(?:/tmp/|/var/tmp/|/var/folders/|\\AppData\\Local\\Temp\\|\\Temp\\)[A-Za-z0-9_.=-]*(?:[/\\][A-Za-z0-9_.=-]*)*"
HEX0X = r"\b0[xX][0-9a-fA-F]+\b"
HEXID = r"\b(?=[0-9]*[a-fA-F])[0-9a-fA-F]{7,}\b"
QUANTITY = (
    r"\b\d+h(?:\d+m)?(?:\d+(?:\.\d+)?s)?\b|\b\d+m\d+(?:\.\d+)?s\b"
    r"|\b\d+(?:\.\d+)?\s?(?:ns|[uµ]s|ms|s|m|h|d|B|KB|KiB|MB|MiB|GB|GiB|TB|TiB|bps|Kbps|Mbps|Gbps)\b"
)
VERSION = r"\b\d+(?:\.\d+){1,3}\b"
NUMBER = r"\b\d{4,}\b"

#: (name, pattern, placeholder) after URLs and progress lines.
SIMPLE = [
    ("iso_timestamp", ISO, "<TS>"),
    ("named_timestamp", NAMED, "<TS>"),
    ("syslog_timestamp", SYSLOG, "<TS>"),
    ("slash_timestamp", SLASH, "<TS>"),
    ("epoch", EPOCH, "<TS>"),
    ("clock", CLOCK, "<DUR>"),
    ("uuid", UUID, "<UUID>"),
    ("email", EMAIL, "<EMAIL>"),
    ("ipv4", IPV4, "<IP>"),
    ("ipv6", IPV6, "<IP>"),
    ("temp_path", TEMP, "<TMPPATH>"),
    ("hex_prefixed", HEX0X, "<HEX>"),
    ("hex_id", HEXID, "<HEX>"),
    ("quantity", QUANTITY, "<QTY>"),
    ("version", VERSION, "<NUM>"),
    ("number", NUMBER, "<NUM>"),
]

CRI = r"^\S+\s+(stdout|stderr)\s+[FP]\s+(.*)\Z"
JOURNALD = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+" + _CLOCK + r"\s+\S+\s+([\w.-]+(?:\[\d+\])?):\s?(.*)\Z"
LEADING = rf"^(?:{ISO}|{SYSLOG}|{SLASH})[ \t:-]*"
ATTRIBUTE = r"^([A-Za-z_@][A-Za-z0-9_.@-]{0,39})=(?!=)"
PLACEHOLDER = r"<[A-Z*!]+>"
