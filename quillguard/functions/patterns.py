"""Patterns and word lists of the detectors, for Java's and RE2's dialects.

The guards say that no letter, number or underscore touches a match.  RE2 has no lookaround;
there the guard is a word boundary (``\\b``) next to a word character and ``\\B`` next to
any other, which is the same on ASCII text.
"""

from __future__ import annotations

#: Order of detection; ties in the merge keep it.
ORDER = ("SSN_DASHED", "SSN_PLAIN", "PHONE", "EMAIL", "MRN", "DOB", "CREDIT_CARD", "IPV4", "IPV6", "PASSPORT")
STRUCTURED = ("SSN", "PHONE", "EMAIL", "MRN", "DOB", "CREDIT_CARD", "IPV4", "IPV6", "PASSPORT")
ENTITY = {k: "SSN" if k.startswith("SSN") else k for k in ORDER}

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_D, _S = r"\p{Nd}", r"[\s\x1c-\x1f\x85\p{Z}]"
SPACES = _S + "+"

# Fixed values.
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_HEX = "[0-9a-fA-F]{1,4}"
STRIP = "()[]{}:;.,!?#\"'"
SSN_TRIGGERS = "ssn social security taxpayer tin tax identification ss# w-2 w-9 w2 w9 1099 itin identity verification background".split()
SSN_BIGRAMS = ["social security", "tax id", "taxpayer identification", "taxpayer id", "background check", "identity verification"]
SSN_NEGATIVES = "phone call fax tel telephone mobile cell dial ext order order# confirmation tracking serial account routing invoice zip postal code ref reference case# ticket po".split()
DOB_TRIGGERS = "dob birth born birthday birthdate age newborn neonatal".split()
DOB_BIGRAMS = ["date of"]
DOB_NEGATIVES = "meeting appointment scheduled deadline due expires expiration created updated filed issued effective invoice report".split()
CARD_TRIGGERS = "visa mastercard amex discover card credit debit cc pan cvv".split()
CARD_NEGATIVES = "id identifier tracking order receipt routing transaction".split()


def _guarded(core: str) -> str:
    return f"{_BEFORE}(?:{core}){_AFTER}"


def _java_octets() -> str:
    o = _OCTET.replace(r"\d", _D)
    return rf"{o}(?:\.{o}){{3}}"


#: Java patterns.
JAVA = {
    "SSN_DASHED": _guarded(rf"(?!000|666|9{_D}{_D}){_D}{{3}}-(?!00){_D}{{2}}-(?!0000){_D}{{4}}"),
    "SSN_PLAIN": _guarded(rf"{_D}{{9}}"),
    "PHONE": _guarded(rf"\({_D}{{3}}\){_S}?{_D}{{3}}-{_D}{{4}}|\+{_D}{{1,3}}(?:[\s\x1c-\x1f\x85\p{{Z}}\-.]?\(?{_D}{{1,4}}\)?){{2,6}}"),
    "EMAIL": _guarded(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "MRN": "(?i)" + _guarded(rf"MRN-{_D}{{7}}"),
    "DOB": _guarded(rf"(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]{_D}|3[01])/(?:19|20){_D}{{2}}|{_D}{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]{_D}|3[01])"),
    "CREDIT_CARD": _guarded(rf"{_D}{{4}}[- ]{_D}{{4}}[- ]{_D}{{4}}[- ]{_D}{{4}}|{_D}{{16}}"),
    "IPV4": _guarded(_java_octets()),
    "IPV6": _guarded("|".join([rf"::(?:ffff(?::0{{1,4}})?:)?{_java_octets()}", rf"(?:{_HEX}:){{6}}{_java_octets()}", rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{1,6}}:(?:{_HEX}(?::{_HEX}){{0,5}})?", rf"::(?:{_HEX}(?::{_HEX}){{0,6}})?"])),
    "PASSPORT": _guarded(rf"[A-Z]{_D}{{8}}"),
}

_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
#: RE2 patterns, for SQL.  Parts of dashed identity numbers are checked after matching.
RE2 = {
    "SSN_DASHED": r"\b\d{3}-\d{2}-\d{4}\b",
    "SSN_PLAIN": r"\b\d{9}\b",
    "PHONE": r"\B(?:\(\d{3}\)\s?\d{3}-\d{4}\b|\+\d{1,3}(?:[\s\-.]?\(?\d{1,4}\)?){1,5}[\s\-.]?\(?\d{1,4}(?:\)\B|\b))",
    "EMAIL": r"(?:\b[a-zA-Z0-9_]|\B[.%+-])[a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "MRN": r"(?i)\bMRN-\d{7}\b",
    "DOB": r"\b(?:(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}|\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b",
    "CREDIT_CARD": r"\b(?:\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}|\d{16})\b",
    "IPV4": rf"\b{_V4}\b",
    "IPV6": "(?:" + "|".join([rf"\B::(?:ffff(?::0{{1,4}})?:)?{_V4}\b", rf"\b(?:{_HEX}:){{6}}{_V4}\b", rf"\b(?:{_HEX}:){{7}}{_HEX}\b", rf"\b(?:{_HEX}:){{1,6}}:(?:{_HEX}(?::{_HEX}){{0,5}}\b|\B)", rf"\B::(?:{_HEX}(?::{_HEX}){{0,6}}\b|\B)"]) + ")",
    "PASSPORT": r"\b[A-Z]\d{8}\b",
}
