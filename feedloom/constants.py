"""They decide the results and must stay exactly as they are."""

# White space that trimming removes and separators match (ECMAScript set).
SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set, and the line ends, for use inside a character class of a pattern.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
LINE_END_CLASS = r"\n\r\u2028\u2029"

# Line markers
COMMENT = "#"
INCLUDE = "api://"

# Schemes: of text and CSV records, skipped in link lists, with a JSON payload
PLAIN_SCHEME = "vless"
SKIPPED_SCHEMES = ("ssr",)
JSON_SCHEMES = ("vmess",)
JSON_FIELDS = "add string, port string, ps string"

# Ports
TLS_PORT = "443"
PLAIN_PORT = "80"

# CSV header words
IP_PREFIX, IP_WORD = "ip", "地址"
PORT_WORDS = ("端口", "port")
TLS_CELL = "tls"
SPEED_WORDS = ("速度", "speed")
CITY_WORDS = ("城市", "city")
COUNTRY_WORDS = ("国家", "country")
IDC_WORDS = ("数据中心", "idc")

# Defaults of the CSV limit setting "limit:cap"
SPEED_LIMIT = 5.0
ROW_CAP = 8

# User agents that get a page instead of text contain this
BROWSER_AGENT = "mozilla"

# Source order in the union
TEXT_RANK, CSV_RANK, LINK_RANK = 0, 1, 2

# Patterns
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
MEASURE = r"(?i)\d+\.?\d*(?= ?[MK]B/s)"
KILO_MEASURE = r"(?i)\d+\.?\d* ?([MK])B/s"
NUMBER = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
# Dotted name, IPv4 or [IPv6], then :port, then #tag to the end of the line.
# The name is written without a repeated group, so long lines cannot exhaust the stack.
ENDPOINT = (
    r"(?i)^((?!\.)(?:(?!\.\.)[\w.-])*\.[a-z-]+|\d{1,3}(?:\.\d{1,3}){3}|\[[a-f0-9:]+\])"
    r"(?::(\d+))?(?:#([^" + LINE_END_CLASS + r"]+)\z)?(?s:.*)\z"
)
LINK = (
    r"^(\w+)://(?:[^@" + SPACE_CLASS + r"]+@)?([^?#/" + SPACE_CLASS + r"]+)"
    r"[^#" + SPACE_CLASS + r"]*(?:#([^" + LINE_END_CLASS + r"]*))?\z"
)
BRACKETED = r"(?i)(\[[a-f0-9:]+\])(?::(\d+))?"
