"""Personal data in texts, disguised or not, with spans in the source text.

Plain identifiers are found in the text as it is.  Disguised ones are found by
offset-preserving deobfuscation: a chain of transducers (homoglyphs and
invisible characters, spelled digits, at/dot disguises) rewrites the text, each
keeping a map from its output to its input; the same detectors run on the last
output, and a hit that touches a rewritten place is mapped back through the
chain to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")

# --- detectors -------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ leftwards over the local part, never into the hit before:
    the same spans as the pattern, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def find_plain(text: str) -> list[Span]:
    """Leftmost non-overlapping hits of each kind; failing hits are dropped, not retried."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


# --- transducers -----------------------------------------------------------

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеорсхуѕіјԁһ", "ABESIJKMHOPCTXYaeopcxysijdh", strict=True))
LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ", "ABEZHIKMNOPTYXavop", strict=True))
# Characters that take no room.
INVISIBLE = {chr(c): "" for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def _by_rule() -> dict[str, str]:
    """Characters whose compatibility form, or whose value as a decimal digit,
    is one visible ASCII character (full-width, mathematical, other digits)."""
    out = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch)
        d = unicodedata.decimal(ch, None)
        if d is not None:
            out[ch] = str(d)
        elif len(plain) == 1 and "!" <= plain <= "~":
            out[ch] = plain
    return out


# The digits 0 to 9 as words.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
PLUS, POINT, AT = "plus|más|mas", "dot|point|punkt|punto", "at|arroba|arobase|ät"


class Rewritten:
    """Output of a transducer: the text, and for each piece of it where it came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.out, self.src = [], [], []  # piece starts in the output; (source start, end, copied?)
        at = size = 0
        for a, b, new in [*edits, (len(source), len(source), "")]:
            for start, end, text, copied in ((at, a, source[at:a], True), (a, b, new, False)):
                if text:
                    self.out.append(size)
                    self.src.append((start, end, copied))
                    parts.append(text)
                    size += len(text)
            at = b
        self.text = "".join(parts)

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """Source span of output characters [a, b), and whether an edit lies in it."""
        i, j = bisect_right(self.out, a) - 1, bisect_right(self.out, b - 1) - 1
        start, _, copied = self.src[i]
        first = start + (a - self.out[i] if copied else 0)
        start, end, copied = self.src[j]
        last = start + (b - self.out[j]) if copied else end
        edited = j > i or not self.src[i][2]
        return first, last, edited


class Lookalikes:
    """Homoglyphs to ASCII; invisible characters to nothing."""

    def __init__(self):
        self.table = _by_rule() | LOOKALIKES | INVISIBLE
        self.known = frozenset(self.table)

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        if text.isascii() or not (here := self.known.intersection(text)):
            return []
        return [(m.start(), m.end(), self.table[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, here)) + "]", text)]


class SpelledDigits:
    """Runs of three or more digits with digit words among them: words become
    digits, ``plus`` before them ``+``, ``dot`` between them a point; the gaps
    between them (white space, hyphens, commas) close.  Words of one language
    at a time.  Where a part between commas or line ends is an identifier by
    itself, the parts of a run are rewritten one by one."""

    BREAK = re.compile(r"[^,\r\n]+")

    #: A digit word and what may follow it in a run: every run starts so.
    GATE = re.compile(r"(?<!\w)(?:" + "|".join(sorted({w for words in DIGIT_WORDS.values() for w in words.split()}, key=len, reverse=True))
                      + rf")[\s,-]++(?:[0-9]|(?:{'|'.join([POINT, *DIGIT_WORDS.values()]).replace(' ', '|')})(?!\w))", re.I)

    def __init__(self):
        self.runs = []
        for words in DIGIT_WORDS.values():
            names = words.split()
            value = {w: str(i) for i, w in enumerate(names)}
            word = "|".join(sorted(names, key=len, reverse=True))
            run = rf"(?<!\w)(?:(?:{PLUS})[\s,-]++|\+\s*+)?(?:{word})(?:[\s,-]++(?:{word}|{POINT}|[0-9]+))+(?!\w)"
            self.runs.append((re.compile(run, re.I), re.compile(rf"({word})|({POINT})|({PLUS}|\+)|[0-9]+", re.I), value))

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        if not self.GATE.search(text):
            return found
        for run, part, value in self.runs:
            def rewritten(a, b):
                parts = list(part.finditer(text, a, b))
                new = "".join(value[p.group(1).lower()] if p.group(1) else "." if p.group(2) else "+" if p.group(3) else p.group() for p in parts)
                return a, b, new, sum(bool(p.group(1)) for p in parts)

            for m in run.finditer(text):
                pieces = [rewritten(*m.span())]
                if pieces[0][3] < 3:
                    continue
                alone = [rewritten(*p.span()) for p in self.BREAK.finditer(text, *m.span())]
                if len(alone) > 1 and any(n >= 3 and find_plain(new) for _, _, new, n in alone):
                    pieces = [p for p in alone if p[3] >= 3]
                if not any(a < m.end() and m.start() < b for a, b, _ in found):
                    found += [p[:3] for p in pieces]
        return sorted(found)


#: Generic suffixes; of two letters, any is a country's.
GENERIC = "com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|tel|asia|cat|post|dev|app|online|site|website|shop|store|xyz|tech|cloud|blog|email|live|life|world|today|news|space|club|link|group|team|agency|digital|studio|design|media|network|systems|solutions|services|company|support|software|academy|center|global|art|music|wiki|page|top|vip|berlin|london|paris|swiss|eus|gal|bzh|scot"
#: Those that are no words of prose.
NO_WORDS = frozenset("com org net edu gov mil info biz dev app".split())
# Words of prose that name no host, and two-letter words that may follow "at ... point".
NO_HOST = frozenset("a an the this that these those some any each every one which what no all another his her its my your our their first last least most same".split())
SHORT_WORDS = frozenset("am an as at be by do go he if in is it me my no of on or so to up us we".split())


#: Bounds of mail addresses: labels of a host, parts of a name, characters of a part.
LABELS, PARTS, PART = 126, 32, 64


class AtDot:
    """[at], (dot) and the like anywhere; bare ``at`` and ``dot`` only as
    ``name at host dot suffix`` with a generic or two-letter suffix.  Prose
    stays as it is by its shape: words such as ``this`` name no host, and
    ``at ... point`` in English goes on with a word, not with a suffix.  Each
    ``at`` reads a bounded number of parts to both sides, so the time is linear
    in the text."""

    GAP = r"[\s,]++"
    MARK = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+(?:(@|{AT})|(\.|{POINT}))\s*+[\])}}>]\s*+", re.I)
    #: A bare ``at`` or @ right behind a name; what stands before and behind it is read from there.
    HERE = re.compile(rf"(?<=[\w.%+-])(?:{GAP}(?P<word>{AT})(?=[\s,])|\s*+@)", re.I)
    BEHIND = re.compile(rf"(?P<gap>[\s,]*+)(?P<host>[A-Za-z0-9-]{{1,63}}+)(?:(?:{GAP}(?:{POINT}){GAP}|\.)[A-Za-z0-9-]{{1,63}}+){{0,{LABELS}}}?"
                        rf"{GAP}(?P<dot>{POINT}){GAP}(?P<suffix>{GENERIC}|[a-z]{{2}})(?![\w-])(?!{GAP}(?:{POINT}){GAP}(?:{GENERIC}|[a-z]{{2}})(?![\w-]))", re.I)
    DOT = re.compile(rf"{GAP}(?:{POINT}){GAP}", re.I)
    #: Bare hosts need a spelled dot, marks a bracket.
    GATE = re.compile(rf"(?<!\w)(?:{POINT})(?!\w)|[\[({{<]\s*+(?:@|\.|{AT})\s*+[\])}}>]", re.I)

    @staticmethod
    def prose(mark: re.Match, m: re.Match) -> bool:
        suffix = m.group("suffix").lower()
        if suffix in NO_WORDS:
            return False
        if m.group("host").lower() in NO_HOST:
            return True
        return (mark.group("word") or "").lower() == "at" and m.group("dot").lower() == "point" and (len(suffix) > 2 or suffix in SHORT_WORDS)

    @staticmethod
    def name_start(text: str, end: int, least: int) -> int | None:
        """Where the name that ends at ``end`` starts: one part, or several with
        a spelled dot between them, no further left than ``least``."""
        def part(at: int, extra: str) -> int:
            i = at
            while i > least and at - i <= PART and (text[i - 1].isalnum() or text[i - 1] in extra):
                i -= 1
            return i

        def gap(at: int) -> int:
            while at > least and (text[at - 1].isspace() or text[at - 1] == ","):
                at -= 1
            return at

        found, at, extra = None, end, "_.%+-"
        for _ in range(PARTS):
            i = part(at, extra)
            if not 0 < at - i <= PART:
                break
            if i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "_.+-"):
                found = i
            word_end = gap(i)
            word = next((w for w in POINT.split("|") if text[max(least, word_end - len(w)):word_end].lower() == w), "")
            at = gap(word_end - len(word))
            if word_end == i or not word or at == word_end - len(word):
                break
            extra = "_%+-"
        return found

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        if not self.GATE.search(text):
            return []
        found = [(*m.span(), "@" if m.group(1) else ".") for m in self.MARK.finditer(text)]
        done = 0
        for mark in self.HERE.finditer(text):
            if mark.start() < done or not (m := self.BEHIND.match(text, mark.end())) or (not mark.group("word") and "," in m.group("gap")):
                continue
            if (start := self.name_start(text, mark.start(), done)) is None:
                continue
            done = m.end()
            if not self.prose(mark, m):
                found.append((mark.start(), m.end("gap"), "@"))
                found += [(*d.span(), ".") for d in self.DOT.finditer(text, start, done)]
        out: list[tuple[int, int, str]] = []
        for e in sorted(found):
            if not out or e[0] >= out[-1][1]:
                out.append(e)
        return out


def transducers() -> list:
    return [Lookalikes(), SpelledDigits(), AtDot()]


def find_disguised(text: str, chain: list) -> list[Span]:
    """Hits that only show after rewriting, as spans of ``text``."""
    steps, now = [], text
    for t in chain:
        if edits := t.edits(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    found = []
    for kind, a, b in find_plain(now) if steps else []:
        touched = False
        for s in reversed(steps):
            a, b, edited = s.back(a, b)
            touched |= edited
        if touched:
            found.append((kind, a, b))
    return found


def find(text: str, chain: list) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans): a disguised span is added unless a plain one
    of its kind covers it."""
    plain = find_plain(text)
    more = [s for s in find_disguised(text, chain) if not any(p[0] == s[0] and p[1] <= s[1] and s[2] <= p[2] for p in plain)]
    return plain, plain + more


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): one
    row per row of ``docs``.  Counts and digest are of the plain spans,
    ``spans`` lists all, ``n_added`` counts disguised ones.  Null and empty
    texts have no spans; repeated rows repeat their result; an empty table
    gives no rows; other columns are ignored; texts are read whole."""
    make: Callable[[], list] = transducers
    state: list = []

    def judge(ids, texts):
        chain = state or state.extend(make()) or state
        rows = []
        for i, text in zip(ids, texts, strict=True):
            plain, every = find(text, chain)
            counts = [sum(s[0] == k for s in plain) for k in KINDS]
            rows.append((i, *counts, digest(joined(plain, KINDS)), joined(every, KINDS), len(every) - len(plain)))
        return zip(*rows, strict=True)

    kind = docs.schema[id_col].dataType.simpleString()
    columns: list[Column] = [F.col(f"`{id_col}`"), text_or_empty(text_col)]
    return map_texts(docs, columns, judge, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
