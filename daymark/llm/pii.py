"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs and their spelled forms, plus signs and digits, colons
and URL schemes, and identifier cues such as ``iban`` or ``token``. At each anchor a deterministic parser expands to the boundaries of an
e-mail address, a network address or an account, and validates it. Work between anchors is a step of the automaton per
character; an expansion ends at the first character that cannot belong to it.

The spans marked ``base`` are those of four patterns (``BASE``), leftmost and not overlapping within a kind, with failing matches
dropped. The parsers add: e-mail addresses with a spelled ``(at)`` or ``[at]``; IPv6 addresses; accounts, that is IBANs with
right check digits, numbers and tokens behind a cue, and the user part of a URL.

Scale: a row is handled alone, there is no shuffle. Offsets are code points, ends exclusive. A null text is empty.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "account")
#: The base patterns; ``scan`` reaches the same spans from anchors.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP, CARD, PHONE = (re.compile(BASE[k]) for k in ("ip", "card", "phone"))
SPELLED_DOMAIN = re.compile(r" ?([A-Za-z0-9-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]+)+)")
SIX = re.compile(r"[0-9A-Fa-f:]*(?:(?<=:)[0-9]+(?:\.[0-9]+){3})?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
BEHIND_CUE = re.compile(r"(?:[ _-]?(?:id|ID|key|Key|KEY|no\.?|No\.?|nr\.?|Nr\.?|number|Number|NUMBER))?(?:\s?[:=#]\s?|\s)[\"']?(?=[A-Za-z0-9])")
VALUE = re.compile(r"[A-Za-z0-9_-]{6,}(?: [0-9]{2,})*")
AUTHORITY = re.compile(r"[^\s/?#\"'<>]*")
#: Fixed words: cues behind which an identifier stands, and schemes.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "token", "password", "passwd", "secret", "api key", "api_key", "apikey")
SCHEMES = ("://", "mailto:")
SPELLED_AT = ("(at)", "[at]", "(AT)", "[AT]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for word in ("@", "+", ":", *DIGITS, *SPELLED_AT, *SCHEMES):
        made.add_word(word, word)
    for cue in CUES:
        for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
            made.add_word(form, "cue")
    made.make_automaton()
    return made


def scan(text: str, anchors) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, end, base) by kind as in ``KINDS``, then by start."""
    base: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = six_end = 0

    def local_start(at: int, least: int) -> int:
        while at > least and text[at - 1] in LOCAL:
            at -= 1
        return at

    for last, anchor in anchors.iter(text):
        if anchor == "@":
            start = local_start(last, email_end)
            if start < last and (found := DOMAIN.match(text, last + 1)):
                base["email"].append((start, found.end()))
                email_end = found.end()
        elif anchor in DIGITS:
            if last and text[last - 1] in DIGITS:
                continue
            if last >= ip_end and (found := IP.match(text, last)):
                ip_end = found.end()
                if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in found.group().split(".")):
                    base["ip"].append(found.span())
            if last >= card_end and (found := CARD.match(text, last)):
                card_end = found.end()
                digits = found.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base["card"].append(found.span())
        elif anchor == "+":
            if last >= phone_end and (found := PHONE.match(text, last)):
                phone_end = found.end()
                if 8 <= sum(c in DIGITS for c in found.group()) <= 15:
                    base["phone"].append(found.span())
        elif anchor == ":":
            if last < six_end:
                continue
            start = last
            while start and last - start < 4 and text[start - 1] in "0123456789ABCDEFabcdef":
                start -= 1
            if start and (text[start - 1].isalnum() or text[start - 1] in ":_"):
                continue
            found = SIX.match(text, start)
            six_end = found.end()
            part = found.group().rstrip(":") if not found.group().endswith("::") else found.group()
            after = text[start + len(part) : start + len(part) + 1]
            if len(part) < 46 and part.count(":") >= 2 and sum(map(bool, part.split(":"))) >= 3 and any(c in DIGITS for c in part) and not after.isalnum():
                try:
                    ipaddress.IPv6Address(part)
                except ValueError:
                    continue
                more["ip"].append((start, start + len(part)))
        elif anchor in SPELLED_AT:
            begin = last - len(anchor) + 1
            end = begin - 1 if begin and text[begin - 1] == " " else begin
            start = local_start(end, 0)
            if start < end and (found := SPELLED_DOMAIN.match(text, last + 1)):
                more["email"].append((start, found.end()))
        elif anchor == "://":
            authority = AUTHORITY.match(text, last + 1).group()
            if (at := authority.rfind("@")) > 0:
                more["account"].append((last + 1, last + 1 + at))
        elif anchor == "cue":
            if (before := BEHIND_CUE.match(text, last + 1)) is None:
                continue
            number = IBAN.match(text, before.end())
            if number and iban_valid(number.group().replace(" ", "")):
                more["account"].append(number.span())
            elif value := VALUE.match(text, before.end()):
                head = value.group().split(" ")[0]
                if sum(c in DIGITS for c in value.group()) >= 6 and sum(c in DIGITS for c in head) >= 2:
                    more["account"].append(value.span())
    out = []
    for kind in KINDS:
        spans = [(s, e, True) for s, e in base[kind]]
        reach = -1
        for s, e in sorted(set(more[kind])):
            if s >= reach and not any(s < e2 and s2 < e for s2, e2 in base[kind]):
                spans.append((s, e, False))
                reach = e
        out += [(kind, s, e, b) for s, e, b in sorted(spans)]
    return out


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in square brackets; of overlapping spans the first one counts."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """(doc_id, spans) of every row, and ``redacted_text`` on demand. Reads doc_id and text only."""

    def run(batches):
        anchors = automaton()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [scan(t, anchors) for t in texts]
            columns = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in found], ARROW_SPANS)]
            names = ["doc_id", "spans"]
            if redacted:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()))
                names.append("redacted_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id long, spans {SPAN_TYPE}" + (", redacted_text string" if redacted else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
