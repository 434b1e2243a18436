"""Regular expressions of the text rules, in a spelling that Java and RE2 read alike."""

THAI = r"\x{0E00}-\x{0E7F}"
THAI_DIGIT = r"\x{0E50}-\x{0E59}"
DIGIT = f"0-9{THAI_DIGIT}"
MARKS = r"\x{0E31}\x{0E34}-\x{0E3A}\x{0E47}-\x{0E4E}"
TONES = r"\x{0E48}-\x{0E4B}"
CONSONANT = r"\x{0E01}-\x{0E2E}"
SPACES = r"[\s\x{00A0}\x{FEFF}]"
TRIM = rf"^{SPACES}+|{SPACES}+$"
#: The same signs, for functions that trim a set of them.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"

_LABEL = "[a-z0-9](?:[-a-z0-9]{0,61}[a-z0-9])?"
_MAILBOX = r"[-\w.+%&'*/=?^`{|}~!#$]+"
EMAIL = rf"(?i)^{_MAILBOX}@{_LABEL}(?:\.{_LABEL})+$"
URL = r"(?i)^(?:www\.|https?://)\S+$"
PHONE = rf"^\+?[{DIGIT}][-.()\s{DIGIT}]" + "{5,}$"
CODE = r"^[A-Za-z0-9][-#\\/:._A-Za-z0-9]*$"
CODE_SIGN = r"[-#\\/:._]"
PATH = r"^(?:/|[A-Za-z]:\\)[^\n]+$"
VERSION = r"^\d+(?:[.]\d+){1,4}$"
PUNCTUATION = r"^[\p{S}\p{P}]+$"

TOKEN = "|".join([
    r"\s+",
    r"[Hh][Tt][Tt][Pp][Ss]?://\S+",
    r"[Ww][Ww][Ww]\.\S+",
    rf"{_MAILBOX}@[-.A-Za-z0-9]+",
    r"[A-Za-z0-9]+(?:[-#\\/:._][A-Za-z0-9]+)+",
    f"[{THAI}]+",
    r"[A-Za-z]+(?:[-.'\x{2019}][A-Za-z]+)*",
    f"[{DIGIT}]+(?:[-/:,.][{DIGIT}]+)*",
    r"\S",
])

_GROUPED = r"(?:\d{1,3}(?:,\d\d\d)+|\d+)"
STRICT = {
    "integer": r"^[+-]?\d+$",
    "decimal": rf"^[+-]?{_GROUPED}(?:\.\d+)?$",
    "currency": rf"(?i)^(?:\x{{0E3F}}|€|\$|EUR|USD|THB)?\s*-?{_GROUPED}(?:\.\d{{1,2}})?$|^\({_GROUPED}(?:\.\d{{1,2}})?\)$",
    "percentage": r"^[+-]?\d+(?:\.\d+)?\s*%$",
    "date": r"^(?:3[01]|[12]\d|0?[1-9])[-./](?:1[0-2]|0?[1-9])[-./](?:\d{4}|\d{2})$",
    "time": r"^(?:2[0-3]|[01]?\d)[.:]?[0-5]\d(?:\s*\x{0E19}\.)?$",
    "number": rf"^[+-]?{_GROUPED}(?:\.\d+)?$",
}
AMBIGUOUS = r"[GBZSlIOo|]"

#: Column types told by the header, in this order.
HEADER_TYPES = [
    ("running_number", "number|no\\.?|ที่|ลำดับ"),
    ("name", "surname|name|นามสกุล|ชื่อ"),
    ("organization", "organization|department|แผนก|กอง|ฝ่าย|หน่วยงาน"),
    ("date", "date|วันที่"),
    ("time", "time|เวลา"),
    ("currency", "total|price|amount|บาท|ราคา|ยอด|จำนวนเงิน"),
    ("percentage", "%|percent|เปอร์เซ็นต์|ร้อยละ"),
    ("email", "email|อีเมล"),
    ("phone", "tel|phone|เบอร์|โทรศัพท์"),
    ("document_code", "ref\\.?|reference|ticket|code|รหัส|เลขที่"),
    ("status", "status|สถานะ"),
    ("description", "หมายเหตุ|remark|description|คำอธิบาย|รายละเอียด"),
]
VALUE_TYPES = ["email", "phone", "date", "currency", "percentage", "integer", "decimal", "document_code"]
