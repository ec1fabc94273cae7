"""Text garbled by decoding with the wrong character encoding: found by a hidden Markov model, and restored.

The model has one clean state, one state per pair (encoding the text was in, encoding it was read as), and one for
characters lost in decoding. Only characters outside ASCII are labelled, as ASCII reads alike in every pair; a character
reference such as ``&#195;`` is labelled as the character it stands for. A state emits what its inverse transform turns
into a likely clean character: likely after the clean character before it, as counted over all documents, and fitting its
neighbours; a character the pair cannot have produced is impossible in that state. The best path labels the characters,
and each labelled span gets its state's inverse transform. Text garbled twice the usual way is a state of its own; what
else was garbled twice is restored in two turns.

Likelihoods are counted in two rounds: over all runs that do not read as garbled UTF-8, then over what the model of the
first round labels clean. The best path is only searched for in texts whose runs some states explain so much better than the
clean one, the cost of switching left out, that it could pay to enter one; in all others it is clean throughout.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAN = "clean"
LOST = "lost"
ENTER, LEAVE = -6.0, -2.0
#: Added where a span would begin or end within a run of characters outside ASCII, as in the middle of a word.
INSIDE = -3.0
TURNS = 2
TWICE = "utf8>cp1252>cp1252"
LONGEST = 13
#: Weight of the character before against the character alone, and buckets in which pairs of characters are counted.
BEFORE_WEIGHT = 0.85
PAIR_BUCKETS = 1 << 18
REPLACEMENT = "�"
#: Single-byte encodings that UTF-8 text was read as.
UTF8_READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r")
#: (true, read as) single-byte encodings.
BYTE_PAIRS = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
              ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp1250", "cp1251"))
SCHEMA = "doc_id bigint, garbled boolean, text string, spans array<struct<start:int,end:int,pair:string>>"


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte, above ASCII; undefined bytes read as the control character of that number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if codec == "cp1252":  # also read as ISO 8859-1
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


BYTES = {c: _bytes_of(c) for c in {*UTF8_READ_AS, *(r for _, r in BYTE_PAIRS)}}
CHARS = {c: {b: ch for ch, b in reversed(_bytes_of(c).items())} for c in {t for t, _ in BYTE_PAIRS}}  # the first of two wins
INVERSE = {f"{t}>{r}": {ch: CHARS[t][b] for ch, b in BYTES[r].items() if b in CHARS[t]} for t, r in BYTE_PAIRS}
STATES = (CLEAN, *(f"utf8>{c}" for c in UTF8_READ_AS), TWICE, *INVERSE, LOST)
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
RUN = re.compile(r"[^\x00-\x7f]+")
#: The same with the characters before and after each run.
RUN_BETWEEN = re.compile(r"(?s)(?:(?<=(.))|^)([^\x00-\x7f]+)(?=(.?))")
#: Runs whose scores a worker remembers.
REMEMBERED = 1 << 17


@lru_cache(1 << 16)
def decoded(chars: str, codec: str) -> tuple[str, int] | None:
    """The character that ``chars`` begins with if they are UTF-8 bytes read as ``codec``, and how many were used."""
    table = BYTES[codec]
    first = table.get(chars[0])
    if first is None or not 0xC2 <= first <= 0xF4:
        return None
    n = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    if len(chars) < n:
        return None
    raw = [table.get(c, -1) for c in chars[:n]]
    if min(raw) < 0:
        return None
    try:
        return bytes(raw).decode("utf-8"), n
    except UnicodeDecodeError:
        return None


@lru_cache(1 << 16)
def decoded_twice(chars: str) -> tuple[str, int] | None:
    """As ``decoded`` for UTF-8 read as Windows-1252, written as UTF-8 and read as Windows-1252 again."""
    inner, i = "", 0
    while i < len(chars) and len(inner) < 4:
        hit = decoded(chars[i:i + 4], "cp1252")
        if hit is None:
            return None
        inner, i = inner + hit[0], i + hit[1]
        whole = decoded(inner, "cp1252")
        if whole and whole[1] == len(inner):
            return whole[0], i
    return None


def decodable(run: str) -> bool:
    return any(decoded(run[i:i + 4], c) for i in range(len(run)) for c in UTF8_READ_AS)


def expanded(text: str) -> tuple[str, list[int] | None]:
    """The text with its character references resolved, and for each of its characters, and its end, the offset in the given
    one; None where there are no references."""
    if "&" not in text or not REFERENCE.search(text):
        return text, None
    out, offsets, end = [], [], 0
    for m in REFERENCE.finditer(text):
        meant = html.unescape(m[0])
        if meant == m[0] or (meant == REPLACEMENT and m[0].lower() not in ("&#65533;", "&#xfffd;")):  # a number no character has
            continue
        out += [text[end:m.start()], meant]
        offsets += [*range(end, m.start()), *[m.start()] * len(meant)]
        end = m.end()
    return "".join(out) + text[end:], [*offsets, *range(end, len(text) + 1)]


def _kind(c: str) -> str:
    return "" if not c else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "o" if c <= "\x7f" else "w" if c.isalpha() else "s"


@lru_cache(1 << 16)
def misfit(c: str, before: str, after: str) -> float:
    """Log penalty of a character between neighbours of the kinds lower, upper, letter (w) or sign (s) outside
    ASCII, other or none."""
    category = unicodedata.category(c)
    letters = (before in "lu" and before != "") + (after in "lu" and after != "")
    near = letters + (before == "w") + (after == "w")
    if category in ("Cc", "Cn", "Co"):
        return -8.0
    if category[0] == "L":
        latin = "LATIN" in unicodedata.name(c, "") or c in "ªº"
        if not latin:
            return -6.0 * letters
        out = 0.0
        if category == "Lu" and (before == "l" or (after == "l" and before == "w")):
            out -= 4.0
        if category == "Ll" and before == "u" and after == "u":
            out -= 3.0
        return out
    if category in ("So", "Sm", "Sc", "No", "Sk", "Lm"):
        return -5.0 if near == 2 else -2.0 if category in ("So", "Sk", "Sc") and near else -1.5 if category == "Sm" and before in "luw" and before else 0.0
    if category in ("Pi", "Ps", "Po") and near == 2:
        return -3.0
    return 0.0


def pair_bucket(before: str, c: str) -> int:
    return zlib.crc32((before + c).encode("utf-8", "surrogatepass")) & (PAIR_BUCKETS - 1)


class Model:
    """counts: how often each character outside ASCII stands in clean places, over all documents; befores: how often
    something stands before such a character; pairs: how often the two stand together, by bucket."""

    def __init__(self, counts: dict[str, int], befores: dict[str, int], pairs: dict[int, int]):
        total = sum(counts.values()) + 1000.0
        self.rare = 0.5 / total
        self.alone = {c: (n + 0.5) / total for c, n in counts.items()}
        self.befores, self.pairs = befores, pairs
        #: Log probability that a character outside ASCII is followed by another one at once.
        self.followed = {c: math.log((befores.get(c, 0) + 0.5) / (n + 1.0)) for c, n in counts.items()}
        self.unseen_followed = math.log(0.25)
        self.memo: dict[tuple, list[tuple[int, float, str] | None]] = {}
        self.gains: dict[tuple[str, str, str], float] = {}
        self.likely: dict[tuple[str, str], float] = {}

    def log_likely(self, before: str, c: str) -> float:
        got = self.likely.get((before, c))
        if got is None:
            p, n = self.alone.get(c, self.rare), self.befores.get(before, 0)
            if n:
                p = BEFORE_WEIGHT * min(1.0, self.pairs.get(pair_bucket(before, c), 0) / n) * n / (n + 5) + (1 - BEFORE_WEIGHT * n / (n + 5)) * p
            got = self.likely[before, c] = math.log(max(p, 1e-9))
        return got

    def _emissions(self, chars: str, before: str, after: str) -> list[tuple[int, float, str] | None]:
        """For each state (characters used, log fit to the neighbours, clean text) or None; ``chars``: the next of the run."""
        key = (chars, before, after)
        got = self.memo.get(key)
        if got is not None:
            return got
        c = chars[0]
        if c == REPLACEMENT:  # only decoding makes it
            out = [None] * (len(STATES) - 1) + [(1, 0.0, c)]
            self.memo[key] = out
            return out
        kind_at = lambda n: _kind(chars[n]) if len(chars) > n else after
        out = [(1, misfit(c, before, kind_at(1)), c)]
        for codec in UTF8_READ_AS:
            hit = decoded(chars[:4], codec)
            if hit:
                o, n = hit
                out.append((n, misfit(o, before, kind_at(n)) if o > "\x7f" else -20.0, o))
            elif 0xC2 <= BYTES[codec].get(c, 0) <= 0xDF:  # a lead whose continuation was lost
                out.append((1, -14.0, REPLACEMENT))
            else:
                out.append(None)
        hit = decoded_twice(chars)
        out.append((hit[1], misfit(hit[0], before, kind_at(hit[1])), hit[0]) if hit else None)
        for table in INVERSE.values():
            o = table.get(c)
            out.append(None if o is None else (1, misfit(o, before, kind_at(1)), o))
        lead = chars[1:2] == REPLACEMENT and any(0xC2 <= t.get(c, 0) <= 0xF4 for t in BYTES.values())
        out.append((2, 0.0, REPLACEMENT) if lead else None)  # what begins a character whose rest was lost
        if len(self.memo) > 1 << 18:
            self.memo.clear()
        self.memo[key] = out
        return out

    def _gain(self, before: str, run: str, after: str) -> float:
        """By how much the best path through the run between two characters, switching free, scores better than the clean one."""
        before, after = _kind(before), _kind(after)
        n, first = len(run), "\x01" + before
        best: list[dict[str, float]] = [{} for _ in range(n + 1)]  # score of the best path to a cut, by the character last emitted
        best[0][first] = clean = 0.0
        for k in range(n):
            near = run[k:k + LONGEST] if decoded(run[k:k + 4], "cp1252") else run[k:k + 5]
            got_k = self._emissions(near, before if k == 0 else _kind(run[k - 1]), after)
            for last, p in best[k].items():
                more = self.followed.get(last, self.unseen_followed) if k else 0.0
                for e in got_k:
                    if e is not None:
                        q = p + e[1] + more + (0.0 if e[2] == REPLACEMENT else self.log_likely(last, e[2]))
                        if q > best[k + e[0]].get(e[2], -1e18):
                            best[k + e[0]][e[2]] = q
            if got_k[0] is None:
                clean = -1e18
            else:
                last = run[k - 1] if k else first
                clean += got_k[0][1] + self.log_likely(last, run[k]) + (self.followed.get(last, self.unseen_followed) if k else 0.0)
        return max(best[n].values()) - clean

    def plain(self, runs: list[tuple[str, str, str]]) -> bool:
        """The best path of a text with these runs between their neighbours is clean throughout: all that any other could gain is
        less than what it costs to enter a state and to leave it. Very long runs are left to the search."""
        gained = 0.0
        for run in runs:
            got = self.gains.get(run)
            if got is None:
                got = self._gain(*run) if len(run[1]) <= 64 else math.inf
                if len(self.gains) >= REMEMBERED:
                    self.gains.clear()
                self.gains[run] = got
            gained += got
            if gained > -ENTER - LEAVE - 1e-9:
                return False
        return True

    def label(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, state, clean text) of the emissions of the best path."""
        n = len(STATES)
        score: list[float] = [0.0, *[ENTER] * (n - 1)]
        back: list = [None] * n
        for i, j in (m.span() for m in RUN.finditer(text)):
            before, after = _kind(text[i - 1:i] if i else ""), _kind(text[j:j + 1])
            size = j - i
            # only as many cuts are kept as the longest emission reaches: a run may be as long as a text
            ring = min(size, LONGEST) + 1
            at: list[list[float]] = [[-1e18] * n for _ in range(ring)]
            frm: list[list] = [[None] * n for _ in range(ring)]
            at[0], frm[0] = score, back
            for k in range(size):
                here, came = at[k % ring], frm[k % ring]
                top = max(range(n), key=here.__getitem__)
                # switching: to clean, and from clean into any other
                inside = INSIDE if k else 0.0
                leave = here[top] + (0.0 if top == 0 else LEAVE + inside)
                start = here[0] + ENTER + inside
                if leave > here[0]:
                    start = max(start, leave + ENTER)
                    here[0], came[0] = leave, came[top]
                for s in range(1, n):
                    if start > here[s]:
                        here[s], came[s] = start, came[0]
                near = text[i + k:min(i + k + 5, j)]
                if decoded(near[:4], "cp1252"):  # only what may be garbled twice is looked at further on
                    near = text[i + k:min(i + k + LONGEST, j)]
                got = self._emissions(near, before if k == 0 else _kind(text[i + k - 1]), after)
                first = "\x01" + before
                for s in range(n):
                    e = got[s]
                    if e is None:
                        continue
                    used, fit, o = e
                    last = first if k == 0 else came[s][4]
                    p = here[s] + fit
                    if o != REPLACEMENT:
                        p += self.log_likely(last, o)
                    if k:
                        p += self.followed.get(last, self.unseen_followed)
                    to = (k + used) % ring
                    if p > at[to][s]:
                        at[to][s] = p
                        frm[to][s] = (came[s], i + k, i + k + used, s, o)
                if k + 1 < size or ring <= size:
                    at[k % ring], frm[k % ring] = [-1e18] * n, [None] * n
            score, back = at[size % ring], frm[size % ring]
        best = max(range(n), key=lambda s: score[s] + (0.0 if s == 0 else LEAVE))
        node, path = back[best], []
        while node is not None:
            path.append(node[1:])
            node = node[0]
        return path[::-1]

    def repair(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The restored text and the garbled spans of the given one; a lost character is garbled beyond repair."""
        spans: list[tuple[int, int, str]] = []
        for turn in range(TURNS):
            shown, offsets = expanded(text)
            at = offsets.__getitem__ if offsets else int
            if self.plain(RUN_BETWEEN.findall(shown)):
                break
            bad = [x for x in self.label(shown) if x[2] and (STATES[x[2]] == LOST or x[3] != shown[x[0]:x[1]])]
            mend = [(at(a), at(b), o) for a, b, state, o in bad if STATES[state] != LOST]
            if turn == 0:
                for a, b, state, _ in bad:
                    if spans and spans[-1][1] == at(a) and spans[-1][2] == STATES[state]:
                        spans[-1] = (spans[-1][0], at(b), STATES[state])
                    else:
                        spans.append((at(a), at(b), STATES[state]))
            if not mend:
                break
            out, end = [], 0
            for a, b, o in mend:
                out += [text[end:a], o]
                end = b
            text = "".join(out) + text[end:]
        return text, spans


def tally(texts, counts: Counter, model: Model | None = None) -> None:
    """Adds to ``counts`` the characters outside ASCII, what stands before them, and both together: of runs that do not read
    as garbled UTF-8, or with a model of what it labels clean. Equal runs between equal neighbours are counted together."""
    seen: Counter = Counter()

    def settle() -> None:
        for (before, run, _), n in seen.items():
            if model is None and (REPLACEMENT in run or decodable(run)):
                continue
            last = "\x01" + _kind(before)
            for c in run:
                counts["c" + c] += n
                counts["b" + last] += n
                counts[f"p{pair_bucket(last, c)}"] += n
                last = c
        seen.clear()

    for text in texts:
        if not text or text.isascii():
            continue
        runs = RUN_BETWEEN.findall(text)
        if model is None or model.plain(runs):
            seen.update(runs)
        else:
            dirty = [0] * (len(text) + 1)  # how many characters before each are not clean
            for a, b, state, _ in model.label(text):
                if state:
                    dirty[a + 1:b + 1] = [1] * (b - a)
            dirty = list(accumulate(dirty))
            seen.update(run for run, m in zip(runs, RUN.finditer(text)) if dirty[m.start()] == dirty[m.end()])
        if len(seen) > REMEMBERED:
            settle()
    settle()


def model_of(counts: dict[str, int]) -> Model:
    part = lambda k: {x[1:]: n for x, n in counts.items() if x[0] == k}
    return Model(part("c"), part("b"), {int(x): n for x, n in part("p").items()})


_WORKERS: dict[str, Model] = {}


def worker_model(token: str, shared) -> Model:
    """The model of a broadcast tally, built once in each Python worker."""
    if token not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[token] = model_of(shared.value)
    return _WORKERS[token]


def character_counts(documents: DataFrame, before: dict[str, int] | None = None) -> dict[str, int]:
    """The tally over all documents, or with the tally ``before`` of what its model labels clean. At most two rows per
    character of Unicode and one per bucket come to the driver."""
    shared = documents.sparkSession.sparkContext.broadcast(before) if before else None
    token = uuid.uuid4().hex

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        model = worker_model(token, shared) if shared else None
        for df in frames:
            tally(df["text"], counts, model)
        yield pd.DataFrame(list(counts.items()), columns=["c", "n"])

    rows = documents.where("text is not null").select("text").mapInPandas(count, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {r["c"]: r["n"] for r in rows.collect()}


def repaired(documents: DataFrame) -> DataFrame:
    """``(doc_id, garbled, text, spans)`` of every document: whether it holds garbled characters, the text as far as it
    can be restored (the given one where clean), and the garbled spans of the given text with their pair.

    Null texts stay null and are not garbled; texts are read whole; rows with one id are all kept; other columns are
    ignored. Three scans, no shuffle of texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(character_counts(documents, character_counts(documents)))
    token = uuid.uuid4().hex

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(token, shared)
        for df in frames:
            rows = []
            for doc_id, text in zip(df["doc_id"], df["text"]):
                if not text or (text.isascii() and "&" not in text):
                    rows.append((doc_id, False, text, []))
                else:
                    new, spans = model.repair(text)
                    rows.append((doc_id, bool(spans), new, spans))
            yield pd.DataFrame(rows, columns=["doc_id", "garbled", "text", "spans"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(mend, SCHEMA)
