"""Personal data: span candidates, boosted trees on format and context, redaction."""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, precise_threshold
from .common import documents, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: ``[0-9]+(\\.[0-9]+){3}``; as the pattern begins with a whole run of digits, no other start matches.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Candidates beyond the base formats: an address with words for its signs, groups of
#: digits with other separators, and colon-separated hexadecimal groups.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?:\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s(?:at|AT)\s)[A-Za-z0-9-]+(?:(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{2,})+")
#: Where a spelled "@" may stand: every match of SPELLED has one after its first run of LOCAL characters.
SIGN = re.compile(r"(?=[\[({]\s?(?:at|AT)\s?[\])}]|\s[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:at|AT)\s)")
#: A run of digit groups, with what stands behind; every stretch of its groups is looked at.
GROUPS = re.compile(r"[(0-9][0-9() ./-]{8,}+")
DIGITS = re.compile(r"[0-9]+")
MOST_GROUPS = 8
HEX_GROUPS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}")
#: Addresses with a "::", and what would make it part of a word or of a longer run.
HEX_SHORT = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")
BEFORE, AFTER = re.compile(r"([0-9]+)[() ./-]{1,3}\Z"), re.compile(r"[() ./-]{1,3}([0-9]+)")
#: Characters of context before a candidate.
CONTEXT = 32
PRECISION = 0.995
HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "master", "credit", "pay", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "ring"),
}
AGAINST = ("order", "version", "isbn", "id", "no.", "number", "page", "date", "invoice", "ref", "serial", "year", "part", "sku")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def byte(digits: str) -> bool:
    """Whether digits, however many, are a number of at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base formats, sorted by start, then kind as listed."""
    found, end, sign = [], 0, text.find("@")
    while sign >= 0:  # a match holds its "@" and starts in the run of characters before it
        start = sign
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if m := start < sign and EMAIL.match(text, start):
            end = m.end()
            found.append((start, end, "email"))
        sign = text.find("@", max(end, sign + 1))
    for m in IP.finditer(text):
        if all(byte(x) for x in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def spelled(text: str) -> list[tuple[int, int]]:
    """All that SPELLED finds, looked for only before a sign."""
    out, end = [], 0
    for sign in SIGN.finditer(text):
        start = sign.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < sign.start() and (m := SPELLED.match(text, start)):
            end = m.end()
            out.append((start, end))
    return out


def stretches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of every stretch of 9 to 19 digits in MOST_GROUPS consecutive groups of a run
    at most; one after a "(" also with it."""
    out = []
    for run in GROUPS.finditer(text):
        groups = [m.span() for m in DIGITS.finditer(text, run.start(), run.end())]
        for i, (a, _) in enumerate(groups):
            n = 0
            for x, y in groups[i : i + MOST_GROUPS]:
                n += y - x
                if n > 19:
                    break
                if n >= 9:
                    out.append((a, y, n))
                    if a > run.start() and text[a - 1] == "(":
                        out.append((a - 1, y, n))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that may be personal data, of every kind whose look they have; they overlap."""
    out = []
    if "at" in text or "AT" in text:
        out += [(a, b, "email") for a, b in spelled(text)]
    for a, b, n in stretches(text):
        if n <= 15:
            out.append((a, b, "phone"))
        if n >= 13:
            out.append((a, b, "card"))
    if ":" in text:
        out += [(m.start(), m.end(), "ip") for m in HEX_GROUPS.finditer(text)]
    if "::" in text:
        out += [(m.start(), m.end(), "ip") for m in HEX_SHORT.finditer(text) if 1 <= len(m.group().replace("::", ":").strip(":").split(":")) <= 7 and len(m.group()) > 2]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, then its context."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    years = sum(1 for g in re.findall(r"[0-9]+", span) if len(g) == 4 and g[:2] in ("19", "20"))
    words = re.findall(r"[a-z.]+", before)
    prior, after = text[start - 1 : start], text[end : end + 1]
    hexes = re.findall(r"[0-9A-Fa-f]+", span)
    left, right = BEFORE.search(text[max(0, start - CONTEXT) : start]), AFTER.match(text, end)
    return [
        len(span), len(digits), len(groups), max(groups), min(groups), groups[-1],
        span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("(") + span.count(")"),
        float(bool(digits) and luhn(digits)), float(digits[:1] == "0"), float(digits[:2] == "00"), years,
        float(groups[-2:] == [3, 4]), float(bool(re.search(r"[\[({]", span)) and kind == "email"), float(bool(re.search(r"\s(?:dot|DOT)\s", span))),
        float(len(set(map(len, hexes))) <= 2 and len(hexes) == 8), float(bool(re.search("[A-Fa-f]", span))),
        float(prior.isalnum() or prior in ".-+/:=#"), float(after.isalnum() or after in "-/:"),
        float(any(w.startswith(HINTS[kind]) for w in words)), float(any(w.startswith(AGAINST) for w in words)),
        float(digits != "" and len(set(digits)) <= 2),
        len(left.group(1)) if left else 0, len(right.group(1)) if right else 0, int(digits[:1] or 0),
        len(groups) > 2 and groups[-3:] == [3, 3, 4], len(groups) == 4 and groups == [4, 4, 4, 4], span.count("(") - span.count(")"),
        span.count("::"), len(hexes), max(map(len, hexes), default=0), sum(map(len, hexes)),
    ]


def examples(seed: int = 7, each: int = 700) -> list[tuple[str, int, int, str, int]]:
    """Made texts with a span of a kind, and whether it is personal data."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda x: x[int(r.integers(len(x)))]
    digits = lambda n: "".join(str(d) for d in r.integers(0, 10, n))
    word = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(int(r.integers(2, 9))))

    def card(n: int, good: bool) -> str:
        while True:
            d = pick("3456") + digits(n - 1)
            if luhn(d) == good:
                return d

    def grouped(d: str, by: list[int], sep: str) -> str:
        cut = np.cumsum([0, *by])
        return sep.join(d[a:b] for a, b in zip(cut, cut[1:]))

    def national() -> str:
        a, b, c = str(r.integers(2, 10)) + digits(2), digits(3), digits(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(6)}", f"1-{a}-{b}-{c}"])

    def no_phone() -> str:
        y = f"{pick(['19', '20'])}{digits(2)}"
        return pick([f"{y}-{digits(2)}-{digits(2)} {digits(2)}.{digits(2)}", f"{y}-{y} {digits(3)}", digits(int(r.integers(9, 16))), f"{digits(1)}.{digits(2)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(2)}/{digits(2)}/{y} - {digits(2)}/{digits(2)}/{y}", f"{digits(5)}-{digits(5)}", f"{y}.{digits(4)}.{digits(5)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(1)} {digits(2)} {digits(3)} {digits(4)} {digits(2)}"])

    def phone_among() -> tuple[str, str, str]:
        """A number beside years, other figures or numbers."""
        y = f"{pick(['19', '20'])}{digits(2)}"
        before = pick(["", f"{y} ", f"{digits(2)} ", f"{digits(1)} ", f"{y}-{digits(2)}-{digits(2)} ", f"{national()} ", f"{national()} / "])
        return before, national(), pick(["", f" {y}", f" {digits(2)}", f" {national()}", f" / {national()}"])

    def stretch_of(whole: str, low: int, high: int) -> tuple[str, str, str]:
        """A proper stretch of the groups of ``whole``, of ``low`` to ``high`` digits; all of it where there is none."""
        found = [(a, b) for a, b, n in stretches(whole) if low <= n <= high and b - a < len(whole)]
        a, b = pick(found) if found else (0, len(whole))
        return whole[:a], whole[a:b], whole[b:]

    def no_phone_among() -> tuple[str, str, str]:
        """A stretch of a row of figures, or one that cuts or joins numbers."""
        rows = [pick([" ", "  ", ".", "/", "-"]).join(digits(int(r.integers(1, 7))) for _ in range(int(r.integers(4, 8)))), no_phone() + " " + digits(int(r.integers(2, 6)))]
        y = f"{pick(['19', '20'])}{digits(2)}"
        cut = f"{national()} {pick(['', '/ '])}{national()}"
        real = [x for x in stretches(cut) if (x[0] == 0 or cut[x[0] - 1] in "-.)" or x[1] < len(cut) and cut[x[1]] in "-.") and x[2] <= 15]
        if real and r.random() < 0.4:
            a, b, _ = pick(real)
            if not (a == 0 and b < len(cut) and cut[b] == " "):
                return cut[:a], cut[a:b], cut[b:]
        return ("", f"{pick([y, digits(2)])} {national()}", "") if r.random() < 0.3 else stretch_of(pick(rows), 9, 15)

    def card_among() -> tuple[str, str, str]:
        span = grouped(card(16, True), [4, 4, 4, 4], pick([" ", "-", ".", "/"]))
        return pick(["", "", f"{digits(2)} ", f"{digits(4)}  "]), span, pick(["", f" {digits(2)}/{digits(2)}", f" {digits(3)}"])

    def no_card_among() -> tuple[str, str, str]:
        return stretch_of(pick([" ", ".", "/", "-"]).join(digits(int(r.integers(2, 6))) for _ in range(int(r.integers(5, 9)))), 13, 19)

    def mostly(one, other):
        return lambda: other() if r.random() < 0.4 else one()

    def address() -> str:
        form = pick(["{:04x}", "{:x}", "{:X}"])
        return ":".join(form.format(int(r.integers(0, 65536))) for _ in range(8))

    def short_address() -> str:
        parts = address().split(":")
        a = int(r.integers(1, 5))
        b = int(r.integers(max(a + 2, 4), 9))
        return ":".join([pick(["2001", "fe80", "fd00", "2a02", parts[0]]), *parts[1:a]]) + "::" + ":".join(parts[b:])

    def no_short_address() -> str:
        some = lambda: pick([digits(1), digits(2), pick("abcdef"), pick(["add", "bad", "cafe", "face", "dead", "fed"])])
        return pick([f"{some()}::{some()}", f"{some()}::", f"::{some()}", f"{some()}:{some()}::{some()}"])

    def yes_email() -> str:
        a, d = pick(["(at)", "[at]", " [at] ", " (at) ", " at ", "{at}"]), pick(["(dot)", "[dot]", " [dot] ", " dot ", " (dot) "])
        return f"{word()}.{word()}{a}{word()}{d if a == ' at ' or r.random() < 0.7 else '.'}{pick(['com', 'org', 'net', 'example', 'de', 'fr'])}"

    def no_email() -> str:
        return pick([f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{word()}.{word()}", f"{word()} (at) {word()}.{digits(3)}" if r.random() < 0.1 else f"{word()} at {word()}.{digits(2)}"])

    def hexed(n: int) -> str:
        return ":".join(f"{int(r.integers(0, 65536)):04x}" for _ in range(n))

    make = {
        "phone": (mostly(national, phone_among), mostly(no_phone, no_phone_among)),
        "card": (mostly(lambda: grouped(card(16, True), [4, 4, 4, 4], pick([".", "/", " - "])), card_among), mostly(lambda: pick([grouped(card(16, False), [4, 4, 4, 4], pick([".", "/", " ", "-"])), card(16, False), card(14, False), no_phone(), grouped(digits(15), [3, 3, 3, 3, 3], pick([" ", "."]))]), no_card_among)),
        "email": (yes_email, no_email),
        "ip": (mostly(address, short_address), mostly(lambda: pick([":".join(digits(2) for _ in range(int(r.integers(5, 8)))), hexed(5), hexed(6), ":".join(f"{int(r.integers(0, 256)):02x}" for _ in range(6))]), no_short_address)),
    }
    rows = []
    for kind, both in make.items():
        for i in range(2 * each):
            good = i % 2 == 0
            made = both[not good]()
            ahead, span, behind = ("", made, "") if isinstance(made, str) else made
            lead = [word() for _ in range(int(r.integers(1, 5)))]
            if r.random() < (0.35 if good else 0.05):
                lead.append(pick(HINTS[kind]) + pick(["", ":"]))
            elif r.random() < (0.02 if good else 0.35):
                lead.append(pick(AGAINST) + pick(["", ":", " #"]))
            head = " ".join(lead) + pick([" ", ": "])
            if not good and r.random() < 0.1:
                head += pick(["#", "-", "a"])
            head += ahead
            rows.append((f"{head}{span}{behind} {word()} {word()}.", len(head), len(head) + len(span), kind, int(good)))
    return rows


@functools.cache
def models() -> dict[str, tuple[BoostedTrees, float]]:
    """For each kind its trees and its threshold, calibrated on a third of the examples
    that the trees were not fitted on, for a precision of PRECISION."""
    rows = examples()
    out = {}
    for kind in KINDS:
        own = [x for x in rows if x[3] == kind]
        x, y = np.array([features(*e[:4]) for e in own]), np.array([e[4] for e in own])
        third = np.arange(len(own)) // 2 % 3 == 2
        trees = BoostedTrees(rounds=20).fit(x[~third], y[~third])
        out[kind] = trees, max(0.9, precise_threshold(trees.predict(x[third]), y[third], PRECISION))
    return out


class Taken:
    """The places that spans cover, as sorted intervals that do not overlap."""

    def __init__(self, spans: list) -> None:
        self.starts, self.ends = [], []
        for a, b, _ in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b)
        return at > 0 and self.ends[at - 1] > a

    def add(self, a: int, b: int) -> None:
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def find_spans(texts: list[str], trained: dict) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; candidates of all texts are scored at once.

    A candidate is added if its score reaches its kind's threshold and it touches no base
    span and no added one of a higher score (ties: the earlier, then the longer).
    """
    base = [base_spans(t) for t in texts]
    rows: dict[str, list] = {k: [] for k in KINDS}
    for i, text in enumerate(texts):
        found = candidates(text)
        taken = Taken(base[i]) if found else None
        for a, b, kind in found:
            if not taken.touches(a, b):
                rows[kind].append((i, a, b))
    added: dict[int, list] = {}
    for kind, spots in rows.items():
        if spots:
            trees, limit = trained[kind]
            p = trees.predict(np.array([features(texts[i], a, b, kind) for i, a, b in spots]))
            for (i, a, b), score in zip(spots, p.tolist()):
                if score >= limit:
                    added.setdefault(i, []).append((-score, a, -b, kind))
    out = [(s, s) for s in base]
    for i, more in added.items():
        every, taken = list(base[i]), Taken(base[i])
        for _, a, b, kind in sorted(more):
            if not taken.touches(a, -b):
                taken.add(a, -b)
                every.append((a, -b, kind))
        out[i] = base[i], sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, counts of the base spans of each kind, base_spans
    and spans as text, and with ``redact`` the text with every span as ``<kind>``.

    Spans are in code points, end exclusive.  Null and empty texts have none.  Base
    spans always stay; overlapping base spans of two kinds both stay, and are redacted as one.
    """
    trained = models()
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", *["redacted"] * redact]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for text, (base, every) in zip(texts, find_spans(texts, trained)):
                    counts = [sum(s[2] == k for s in base) for k in KINDS]
                    rows.append((*counts, joined(base), joined(every), *([redacted(text, every)] if redact else [])))
                kinds = [pa.int64()] * 4 + [pa.string()] * (2 + redact)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string" + ", redacted string" * redact
    return docs.select(id_col, text_col).mapInArrow(run, out)


def redacted(text: str, spans: list) -> str:
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
