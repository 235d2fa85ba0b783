"""Personal data in whole texts, also where it is disguised.

Plain identifiers are found in the text itself.  Then transducers rewrite the
text: look-alike letters and digits to ASCII, invisible characters to
nothing, at/dot disguises to ``@`` and ``.``, and spelled digits to digits;
short runs of those, beside digits, last, with a look before and after.
Each keeps, for every character it writes, the source characters it stands
for, so what the same detectors find in the rewritten text is mapped back to
spans of the source.  Spans that rest on a rewritten character are added;
those of the plain text stay.

Per-text work without state: any partitioning, no shuffle.  Detection is
linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a run of digits that fails as a whole fails from its middle too
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            free = m.end()
        else:
            free = max(free, at)  # no later match reaches back over this sign
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def plain_spans(text: str) -> list[Span]:
    """Spans of identifiers in a text as it stands, leftmost and without
    overlaps within a kind; sorted by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# --- transducers --------------------------------------------------------------------

#: Letters of other scripts that look like these ASCII letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "ӏ": "l", "У": "Y", "Ү": "Y", "ү": "y", "ѵ": "v", "ԛ": "q", "ԝ": "w", "Ԍ": "G", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "κ": "k", "τ": "t",
    "υ": "u", "γ": "y", "σ": "o", "Υ": "Y", "ϲ": "c", "ϳ": "j", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Ս": "U", "Օ": "O", "Լ": "L",
    "Տ": "S", "ց": "g", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l",
    "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z", "ɑ": "a", "ɩ": "i",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "﹫": "@", "﹒": ".", "·": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without a mark of their own.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words, in order from zero, per language.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
#: Last parts of host names that an address without brackets may end in.
LAST_PARTS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev co me tv cc cloud online site shop store tech blog email mail news club xyz agency "
    "ac ae ar at au be bg bo br ca ch cl cn cr cy cz de dk do ec ee eg es eu fi fr gr gt hk hr hu id ie il in ir is it jp ke kr lt lu lv ma mx my "
    "ng nl no nz pe ph pk pl pt py ro rs ru sa se sg si sk th tn tr tw ua ug uk us uy ve vn za example test invalid local".split())
#: Words that announce an address, and words before "at" that are no name.
CUES = ("e-?mails?|mail(?:ed|ing|s)?|mailto|contact|reach|write|writes|wrote|address(?:es)?|reply|send|courriel|adresse|correo|direcci[oó]n|schreib\\w*|"
        "kontakt\\w*|[eé]crire|[eé]crivez|escrib\\w*")
NO_NAMES = frozenset("i me us you him her it them we they he she this that these those now here there available found online live back home".split())
MIN_SPELLED = 4  # fewer digit words in a row, without digits beside them, are prose

_WORD_DIGIT = {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words.split())} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(_WORD_DIGIT, key=len, reverse=True))
_SPELLED = re.compile(rf"(?:\b(?:plus)[ -]+|\+)?\b(?:{_DIGIT_WORD})(?:[ ,.-]{{1,3}}(?:{_DIGIT_WORD}|[0-9]+)){{{MIN_SPELLED - 1},}}\b", re.I)
_SPELLED_PART = re.compile(rf"{_DIGIT_WORD}|[0-9]+|plus|\+", re.I)
_AT = re.compile(r" ?[(\[{<] ?(?:at|@) ?[)\]}>] ?", re.I)
_DOT = re.compile(r" ?[(\[{<] ?(?:dot|punkt|point|punto|\.) ?[)\]}>] ?", re.I)
#: words of digits next to each other; with digits on either side they count however few they are
_SHORT = re.compile(rf"\b(?:{_DIGIT_WORD})(?:[ -]{{1,3}}(?:{_DIGIT_WORD}))*\b", re.I)
_SHORT_WORD = re.compile(_DIGIT_WORD, re.I)
_DIGIT_BEFORE = re.compile(r"(?:[0-9][ ().-]{0,3}|\+)\Z")
_DIGIT_AFTER = re.compile(r"[ ().-]{0,3}[0-9]")
#: without brackets only where the last part is letters, as in a name of a host; a spaced '.' only after a sign
_BARE = re.compile(r"(?:(?<! ) +at +|(?P<sign>(?<! ) +@ +|@ *))(?P<host>[A-Za-z0-9-]+(?:(?:(?:\.| +dot +)[A-Za-z0-9-]+)*(?:\.| +dot +)[A-Za-z]{2,24}"
                   r"|(?(sign)(?:(?: +\. +|\.)[A-Za-z0-9-]+)*(?: +\. +|\.)[A-Za-z]{2,24}|(?!)))(?![A-Za-z0-9-]))", re.I)
_CUE_BEFORE = re.compile(rf"\b(?:{CUES})\b[^.!?\n]*\Z", re.I)
CUE_REACH = 40  # characters before the name
_SPELLED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: +(?:dot|punkt|point|punto) +|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_SPELLED_DOT = re.compile(r"[0-9] +(?:dot|punkt|point|punto) +[0-9]", re.I)
_IP_DOT = re.compile(r" +[a-z]+ +", re.I)
_BARE_DOT = re.compile(r" +(?:dot|\.) +", re.I)
_DOT_BEFORE = re.compile(r"(?<! ) +dot +\Z", re.I)


def _simple(char: str) -> str | None:
    """The ASCII stand-in of one character; None: it stands for itself."""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char in INVISIBLE:
        return ""
    if "！" <= char <= "～":  # full-width forms follow ASCII
        return chr(ord(char) - 0xFEE0)
    if "\U0001d400" <= char <= "\U0001d7ff" or "Ⓐ" <= char <= "ⓩ":  # mathematical letters and digits, letters in circles
        plain = unicodedata.normalize("NFKC", char)
        return plain if plain.isascii() else LOOK_ALIKES.get(plain)
    digit = unicodedata.decimal(char, None)
    return None if digit is None else str(digit)


_FOREIGN = re.compile(r"(?![0-9])[\d" + "".join(map(re.escape, sorted(LOOK_ALIKES))) + INVISIBLE
                      + "！-～Ⓐ-ⓩ\U0001d400-\U0001d7ff]")


class Rewritten:
    """A rewritten text: for each character its source span and whether it
    differs from the source."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, None, None, None

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, for edits in order."""
        if not edits:
            return
        if self.starts is None:
            n = len(self.text)
            self.starts, self.ends, self.changed = list(range(n)), list(range(1, n + 1)), bytearray(n)
        parts, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            parts += self.text[at:a], new
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\1" * len(new)
            if not new and changed:  # what was dropped belongs to the character before it
                changed[-1] = 1
            at = b
        self.text = "".join(parts) + self.text[at:]
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]

    def source(self, span: Span) -> Span | None:
        """A span in source offsets; None if it rests on no rewritten character."""
        a, kind, b = span
        return (self.starts[a], kind, self.ends[b - 1]) if any(self.changed[a:b]) else None


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _FOREIGN.finditer(text) if (new := _simple(m[0])) is not None]


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
    return sorted(edits)


def _is_address(text: str, start: int, m: re.Match, spelled: bool) -> bool:
    """Whether a sign without brackets, with a name from ``start`` on, is meant
    as one.  The last part must be one that hosts have, in one case, as words
    that begin a sentence after a missing space are not.  A bare "at" needs a
    second sign of disguise: a spelled dot, a name that prose has not, or a
    word before it that announces an address."""
    host, name = m["host"], text[start:m.start()]
    last = re.split(r"[. ]+", host)[-1]
    if last.lower() not in LAST_PARTS or last not in (last.lower(), last.upper()):
        return False
    if m["sign"] or spelled or _BARE_DOT.search(host):
        return True
    if any(c in "._%+" or c.isdigit() for c in name[1:-1]) or name[-1].isdigit():
        return not name.isdigit()
    return name.lower() not in NO_NAMES and bool(_CUE_BEFORE.search(text, max(0, start - CUE_REACH), start))


def _spelled_ip(text: str) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for m in _SPELLED_IP.finditer(text) for d in _IP_DOT.finditer(text, m.start(), m.end())]


def _bare_at(text: str) -> list[tuple[int, int, str]]:
    edits, free = [], 0
    for m in _BARE.finditer(text):
        dots, start, at = [], m.start(), m.start()
        while start > free:  # the part before the sign, with its spelled dots
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start == at:
                break
            at, low = start, max(free, start - 16)
            if not (d := _DOT_BEFORE.search(text, low, start)) or d.start() <= free or text[d.start() - 1] not in LOCAL:
                break
            dots.append((d.start(), d.end(), "."))
            start = at = d.start()
        if at < m.start() and _is_address(text, at, m, bool(dots)):
            if m.start("host") - m.start() > 1:
                dots.append((m.start(), m.start("host"), "@"))
            dots += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start("host"), m.end())]
            edits += sorted(dots)
            free = m.end()
    return edits


def _beside_digits(text: str) -> list[tuple[int, int, str]]:
    edits, end = [], -9
    for m in _SHORT.finditer(text):
        a, b = m.span()
        if _DIGIT_BEFORE.search(text, max(0, a - 4), a) or _DIGIT_AFTER.match(text, b) or 0 <= a - end <= 3 and not text[end:a].strip(" ().-"):
            edits.append((a, b, "".join(_WORD_DIGIT[w.lower()] for w in _SHORT_WORD.findall(m[0]))))
            end = b
    return edits


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        new = "".join("+" if p.lower() in ("plus", "+") else _WORD_DIGIT.get(p.lower(), p) for p in _SPELLED_PART.findall(m[0]))
        edits.append((m.start(), m.end(), new))
    return edits


#: A transducer and a cheap test of whether it has anything to do.
TRANSDUCERS: tuple[tuple[Callable[[str], bool], Callable[[str], list]], ...] = (
    (lambda t: not t.isascii() and bool(_FOREIGN.search(t)), _look_alikes),
    (lambda t: "(" in t or "[" in t or "{" in t or "<" in t, _at_and_dot),
    (lambda t: "@" in t or " at " in t.lower(), _bare_at),
    (lambda t: True, _spelled),
    (lambda t: bool(_SPELLED_DOT.search(t)), _spelled_ip),
)


def personal_data(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, added spans) of a text in its own offsets, each sorted."""
    if not text:
        return [], []
    base, new = plain_spans(text), Rewritten(text)
    for useful, transducer in TRANSDUCERS:
        if useful(new.text):
            new.apply(transducer(new.text))
    mapped = set() if new.starts is None else {s for x in plain_spans(new.text) if (s := new.source(x)) is not None}
    if DIGIT.search(new.text) and (edits := _beside_digits(new.text)):
        new.apply(edits)
        mapped |= {s for x in plain_spans(new.text) if (s := new.source(x)) is not None}
    return base, _widest(mapped - set(base))


def _widest(spans: set[Span]) -> list[Span]:
    """Spans, sorted, without those inside another of their kind."""
    out: list[Span] = []
    reach: dict[int, int] = {}
    for a, k, b in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if b > reach.get(k, -1):
            out.append((a, k, b))
            reach[k] = b
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets;
    spans that overlap are replaced together, named after the first."""
    base, added = personal_data(text)
    out, at, end = [], 0, 0
    for a, k, b in sorted(base + added, key=lambda s: (s[0], -s[2])):
        if a >= end:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = end = max(end, b)
    return "".join(out) + text[at:] if out else text


def redacted_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    return redact(text)


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a
    row for each document.  The counts and the hash are those of the plain
    identifiers; ``spans`` lists all, also ``n_added`` disguised ones.

    Null and empty texts have no spans.  Repeated rows and null ids each keep
    their row.  Empty input: no rows.  Other columns are not read."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, added = personal_data(t)
            counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added)), len(added)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("m")).select("doc_id", "m.*")
