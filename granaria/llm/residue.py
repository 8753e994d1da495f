"""Template residue and error-page text.

Method. Character n-gram models are fitted for error messages, notices (scripts, cookies, browser checks), filler and page
frames on a bounded set of labelled phrases (``residue_seeds``, no text of the corpus), and for natural prose on the
distinct sentences of the corpus, so that copies of a page or notice don't turn it into prose. A kind's model mixes its
phrases with general language, so wordings that no phrase holds cost a bounded amount. Prose is fitted a second time
without the sentences that the first fit finds covered by residue. Texts are scored by the log-likelihood ratio of each
kind against prose, averaged over sliding windows; the windows localise residue, and a document is excluded if residue
covers most of its body or of the whole. The body is the text without its heading (a first line that is no sentence), navigation
(short cells between separators) and what the frame model covers. Repeated words are found by an adaptive model: the n-grams of
the ``NEAR`` characters before. Placeholders are found by their syntax; whether one was left, or is explained by its
sentence, two further n-gram models decide.

A batch is folded and scored as one array of characters; only texts that windows cover far enough are scored by kind,
which loses none, since a window's mean of the greatest ratio is at least that of each kind. The n-gram tables have ``SLOTS``
entries for each kind, whatever the corpus; letter case, accents and digits are unified.

Odd input: null and empty texts, and texts of nothing but a frame, are no cases; repeated documents are judged each;
texts are scored whole, whatever their length, in pieces that overlap by a window.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granaria.llm import residue_seeds as seeds
from granaria.session import Workspace

ORDER = 5
SLOTS = 1 << 20
WINDOW = 21
#: A window is residue from this mean ratio on; a document from this share of its body, or of its whole text, on.
CUT = 0.0
COVERAGE = 0.6
#: Share of general language in a kind's model, and the most that one n-gram may speak for a kind.
GENERAL = 0.35
MOST = 4.0
#: Sentences of the corpus that a template of general prose counts for.
COMMON = 20
#: Reach of the adaptive model, and the share of a window it must predict.
NEAR = 24
ECHO = 0.5
#: Characters scored at once.
PIECE = 1 << 18
KINDS = ("error", "notice", "filler", "frame")
RESIDUE = 3

# Names of inline and page markup, which are no placeholders.
TAGS = frozenset(
    "a abbr article aside b big blockquote body br button caption center cite code dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub sup table tbody td textarea tfoot th thead time title tr tt u ul var video".split()
)
FIELD = re.compile(
    r"""\{\{[^{}\n]{1,200}\}\}
      | [$#]\{[\w.\- ]{1,60}\}
      | \{%[^{}\n]{1,200}%\}
      | <%=?[^<>\n]{1,200}%>
      | @@[\w.\- ]{1,60}@@
      | %\(\w{1,60}\)[sdrf]
      | <<[\w.\- ]{1,60}>>
      | \[\[[a-z][\w.\-]{0,60}\]\] | \[\[[A-Z][A-Z0-9_.\-]{0,60}\]\]
      | (?<![\w_])__[A-Z][A-Z0-9_ ]{0,60}__(?![\w_])
      | \{[A-Za-z_]\w{0,60}\}
      | <[A-Za-z]\w{1,60}>
      | \[[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ0-9_]{2,60}(?:[\ ][A-ZÀ-ỸĐ0-9_]{1,60}){0,6}\]
      | \[(?i:insert|enter|your|add|fill|nhập|điền|completar|insertar|su|tu)\b[^\]\[\n]{0,80}\]
      | \[[a-z]\w{0,60}\]
      | (?<=[:：])[\ \t]*_{3,}""",
    re.VERBOSE,
)
# Forms that also stand in finished texts; they count only where the sentence speaks for a field left open.
LIKELY = re.compile(r"%[A-Z][A-Z0-9_]{1,40}%|\[[A-ZÀ-ỸĐ][\w'.\-]{0,40}(?: [\w'.\-]{1,40}){0,4}\]|<[^\W\d_][\w'\-]{0,40}(?: [\w'\-]{1,40}){1,4}>|(?<![\w_])_{4,}(?![\w_])")
HINT = re.compile(r"[{\[<$#%@]|__")
#: Least evidence for an explained placeholder, and what a doubtful one needs beyond the other side's.
EXPLAINED, MARGIN = 0.5, 0.5
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»", "„": "“"}
SEPARATORS = (" | ", " › ", " » ", " · ", " > ", " / ", " • ")
CELLS = re.compile("|".join(map(re.escape, SEPARATORS)))
ENDS = re.compile(r"\n|(?<=[.!?])\s")


def _fold_table() -> np.ndarray:
    """Folded character for each of the first 65536: lower case without accents, digits as 0, white space as a blank or a
    line break, 0 for marks and format characters."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c in "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029":
            out[code] = 10
        elif c.isspace():
            out[code] = 32
        elif unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc", "Cs"):
            out[code] = 0
        elif code > 64:
            base = next((x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)), c)
            out[code] = ord({"đ": "d", "ł": "l", "ø": "o", "ı": "i"}.get(base, "0" if base.isdecimal() else base))
        elif 48 <= code < 58:
            out[code] = 48
    return out


FOLD = _fold_table()


def fold_all(texts: list[str], lines: bool = False) -> list[np.ndarray]:
    """Folded characters of each text, runs of white space as one blank; with ``lines`` line breaks stay."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    t = FOLD[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        t[beyond] = codes[beyond]
    if not lines:
        t[t == 10] = 32
    there = t != 0
    if not there.all():
        t, owner = t[there], owner[there]
    blank = t == 32
    again = blank.copy()
    again[1:] &= (t[:-1] <= 32) | (owner[1:] != owner[:-1])
    if again.any():
        t, owner = t[~again], owner[~again]
    return np.split(t, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if texts else []


def grams(codes: np.ndarray) -> np.ndarray:
    """Slot of the n-gram that ends at each position from ORDER - 1 on."""
    n = len(codes) - ORDER + 1
    h = np.zeros(max(n, 0), np.uint32)
    for i in range(ORDER):
        h *= np.uint32(0x9E3779B1)
        h += codes[i : i + n]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(SLOTS - 1)).astype(np.int32)


class Layout:
    """Folded texts end to end, each behind ORDER - 1 blanks: their n-grams, and the window of each character."""

    def __init__(self, parts: list[np.ndarray]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.n, pad = len(parts), ORDER - 1
        starts = np.cumsum(sizes + pad) - sizes
        codes = np.full(int(sizes.sum()) + pad * self.n, 32, np.uint32)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.at = np.arange(len(self.owner), dtype=np.int32) + pad * (self.owner + 1)
        if self.n:
            codes[self.at] = np.concatenate(parts)
        self.slots = grams(codes)  # of position p at p - pad
        begin, end = np.repeat(starts.astype(np.int32), sizes), np.repeat((starts + sizes).astype(np.int32), sizes)
        half = WINDOW // 2
        self.low, self.high = np.maximum(self.at - half, begin) - pad, np.minimum(self.at + half + 1, end) - pad
        self.letter = codes[self.at] != 32
        self.codes = codes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values``, one for each slot position, over the window of each character."""
        total = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=total[1:], dtype=np.float64)
        return total[self.high] - total[self.low]

    def echoes(self) -> np.ndarray:
        """Characters in windows whose n-grams mostly stood just before; digits, which are all alike, don't count."""
        g, again = self.slots, np.zeros(len(self.slots), bool)
        for back in range(1, NEAR + 1):
            again[back:] |= g[back:] == g[:-back]
        again &= self.codes[ORDER - 1 :] != 48
        return self.sums(again) >= ECHO * (self.high - self.low)

    def count(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[flags & self.letter], minlength=self.n)


def tally(parts: list[np.ndarray], model: dict[str, np.ndarray]) -> np.ndarray:
    """For each folded text its characters of each kind, and all of them; the kinds are 0 where they can't reach COVERAGE."""
    out = np.zeros((len(parts), len(KINDS) + 1), np.int64)
    if not parts:
        return out
    x = Layout(parts)
    out[:, -1] = x.count(np.ones(len(x.owner), bool))
    hot = (x.sums(model["any"][x.slots]) > CUT) | x.echoes()
    asked = np.flatnonzero((x.count(hot) >= COVERAGE * out[:, -1]) & (out[:, -1] > 0))
    if len(asked):
        x = Layout([parts[i] for i in asked])
        means = np.stack([x.sums(model[k][x.slots]) for k in KINDS])
        label = np.where(means.max(0) > CUT, means.argmax(0), -1)
        label[x.echoes() & (label != KINDS.index("filler"))] = KINDS.index("filler")
        for i in range(len(KINDS)):
            out[asked, i] = x.count(label == i)
    return out


def _labels(part: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    x = Layout([part])
    means = np.stack([x.sums(model[k][x.slots]) for k in KINDS])
    label = np.where(means.max(0) > CUT, means.argmax(0), -1)
    label[x.echoes()] = KINDS.index("filler")
    return label


def tally_long(part: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The same for one text of any length, in pieces of PIECE characters with as much around them as a window sees."""
    around = WINDOW + NEAR + 2 * ORDER
    out = np.zeros(len(KINDS) + 1, np.int64)
    for low in range(0, len(part), PIECE):
        high, first = min(low + PIECE, len(part)), max(0, low - around)
        label = _labels(part[first : high + around], model)[low - first : high - first][part[low:high] != 32]
        out += np.append([np.count_nonzero(label == i) for i in range(len(KINDS))], len(label))
    return out


def grouped(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts in groups of at most PIECE characters; a longer text is a group of its own."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > PIECE:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def tally_texts(texts: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(texts), len(KINDS) + 1), np.int64)
    for group in grouped(texts):
        parts = fold_all([texts[i] for i in group])
        out[group] = tally_long(parts[0], model) if len(group) == 1 and len(parts[0]) > PIECE else tally(parts, model)
    return out


def shares(tallied: np.ndarray) -> np.ndarray:
    """Share of the body that is error, notice and filler, for each text."""
    size = tallied[:, -1] - tallied[:, KINDS.index("frame")]
    return tallied[:, :RESIDUE] / np.maximum(size, 1)[:, None]


def body(text: str) -> str:
    """The text without its heading and lines of navigation."""
    t = text.strip()
    line, _, rest = t.partition("\n")
    if rest and not line.rstrip().endswith((".", "!", "?", "…", "...")) and len(line.split()) <= 12:
        t = rest.strip()
    if "©" in t or any(s in t for s in SEPARATORS):
        t = "\n".join(filter(None, map(_without_navigation, t.split("\n"))))
    return t


def _without_navigation(line: str) -> str:
    """A line of several cells without those of at most three words; a line of rights is none of the body."""
    if "©" in line:
        return ""
    if max(line.count(s) for s in SEPARATORS) < 2:
        return line
    return " ".join(c for c in CELLS.split(line) if len(c.split()) > 3)


def sentences(documents: DataFrame) -> DataFrame:
    """(sentence) folded, each once whatever its copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts, found = [t for t in x["text"] if t], set()
            for group in grouped(texts):
                joined = fold_all(["\n".join(texts[i] for i in group)], lines=True)[0].tobytes().decode("utf-32-le")
                for end in ". ", "! ", "? ":
                    joined = joined.replace(end, end[0] + "\n")
                found.update(map(str.strip, joined.split("\n")))
            yield pd.DataFrame({"sentence": list(found - {""})}, dtype=object)

    return documents.select("text").mapInPandas(run, "sentence string").distinct()


def count_prose(found: DataFrame, model: Broadcast | None = None) -> DataFrame:
    """(slot, n) over the n-grams of distinct sentences, with a model of those that residue doesn't cover; each task adds
    up its own before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for x in batches:
            texts = list(x["sentence"])
            for group in grouped(texts):
                parts = [np.frombuffer(texts[i].encode("utf-32-le"), np.uint32) for i in group]
                if model is not None:
                    covered = shares(tally(parts, model.value)).sum(1) >= COVERAGE
                    parts = [p for p, c in zip(parts, covered, strict=True) if not c]
                if parts:
                    laid = Layout(parts)
                    total += np.bincount(laid.slots[laid.at - ORDER + 1], minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slots, "n": total[slots]})

    return found.mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _own(kind: str) -> np.ndarray:
    """In how many templates of a kind each n-gram occurs."""
    out = np.zeros(SLOTS)
    for drawn in seeds.phrases(kind) + (seeds.mock_latin() if kind == seeds.FILLER else []):
        if drawn:
            laid = Layout(fold_all(drawn))
            out[np.unique(laid.slots[laid.at - ORDER + 1])] += 1
    return out


def _ratios(counts: DataFrame) -> dict[str, np.ndarray]:
    rows = counts.toPandas()  # at most SLOTS rows
    found = 0.5 + COMMON * _own(seeds.PROSE)
    found[rows["slot"].to_numpy()] += rows["n"].to_numpy() - 1  # what one sentence alone holds is no evidence of prose
    kinds = {"error": seeds.ERRORS, "notice": seeds.NOTICES, "filler": seeds.FILLER, "frame": seeds.FRAME, "mention": seeds.MENTIONS, "left": seeds.LEFT}
    own = {k: _own(v) for k, v in kinds.items()}
    out = {}
    for k, v in own.items():
        prose = found + COMMON * own["mention"] if k in KINDS else found  # sentences that explain a field are prose too
        out[k] = np.minimum(np.log(GENERAL + (1 - GENERAL) * v / v.sum() * prose.sum() / prose), MOST).astype(np.float32)
    out["any"] = np.max([out[k] for k in KINDS], axis=0)
    return out


def fit(documents: DataFrame) -> dict[str, np.ndarray]:
    """Log-likelihood ratios against prose, one table of SLOTS numbers for each kind, and mention against left fields."""
    ws = Workspace(documents.sparkSession, "residue")
    found = ws.save(sentences(documents), "sentences")
    first = documents.sparkSession.sparkContext.broadcast(_ratios(count_prose(found)))  # 7 tables of SLOTS floats
    model = _ratios(count_prose(found, first))
    first.destroy()
    ws.drop("sentences")
    return model


def _quoted(text: str, begin: int, end: int) -> bool:
    before, after = text[:begin].rstrip(" ")[-1:], text[end:].lstrip(" ")[:1]
    return before in QUOTES and after == QUOTES[before]


def left_fields(text: str, model: dict[str, np.ndarray]) -> list[str]:
    """Placeholders left where a value belongs: no markup, and not explained by their sentence. One in quotes, or of a form
    that finished texts hold too, needs a sentence that speaks for a left field."""
    if not HINT.search(text):
        return []
    spans = {m.span(): True for m in FIELD.finditer(text)}
    taken = sorted(spans)
    for m in LIKELY.finditer(text):
        i = bisect.bisect(taken, m.span())
        if not any(a < m.end() and m.start() < b for a, b in taken[max(0, i - 1) : i + 1]):
            spans[m.span()] = False
    if not spans:
        return []
    closed = set(re.findall(r"</([a-z]\w*)>", text.lower()))
    ends = [m.end() for m in ENDS.finditer(text)]
    found, scored = [], {}
    for (begin, end), strong in sorted(spans.items()):
        f = text[begin:end]
        if f[0] == "<" and f[1] not in "<%" and (f[1:-1].lower().split(" ")[0] in TAGS or f[1:-1].lower() in closed):
            continue
        i = bisect.bisect_right(ends, begin)
        if i not in scored:
            start, stop = ends[i - 1] if i else 0, ends[bisect.bisect_left(ends, end)] if bisect.bisect_left(ends, end) < len(ends) else len(text)
            inner = LIKELY.sub("X", FIELD.sub("X", text[start:stop]))
            laid = Layout(fold_all([inner]))
            g = laid.slots[laid.at - ORDER + 1]
            # n-grams that speak for a kind are evidence; unknown wording speaks for neither
            scored[i] = tuple(float(np.maximum(model[k][g], 0).mean()) if len(g) else 0.0 for k in ("mention", "left"))
        mention, left = scored[i]
        if strong and not _quoted(text, begin, end):
            if mention > max(EXPLAINED, left):
                continue
        elif left < mention + MARGIN:
            continue
        found.append(f.strip())
    return found


def text_shares(texts: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    """Share that is error, notice and filler of each text's body, or of the whole where that is more."""
    out = shares(tally_texts(texts, model))
    bodies = [body(t) for t in texts]
    cut = [i for i, (t, b) in enumerate(zip(texts, bodies, strict=True)) if len(b) < len(t.strip())]
    part = shares(tally_texts([bodies[i] for i in cut], model))
    for i, p in zip(cut, part, strict=True):
        if p.sum() > out[i].sum() or not bodies[i].strip():
            out[i] = p
    return out


def residue_shares(text: str, model: dict[str, np.ndarray]) -> dict[str, float]:
    """``text_shares`` of one text, by kind."""
    return dict(zip(KINDS, text_shares([text], model)[0], strict=False))


def judge(documents: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, fields, error, notice, filler, coverage, is_residue) for every document. Shares that can't reach
    COVERAGE together are given as 0. ``keep`` may name the text itself."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents))  # 7 tables of SLOTS floats
    names = list(dict.fromkeys(["doc_id", *keep]))
    chosen = documents.select(*names, *([] if "text" in names else ["text"]))
    schema = ", ".join(f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = model.value
        for x in batches:
            texts = [t or "" for t in x["text"]]
            fields = [left_fields(t, tables) for t in texts]
            part = text_shares(texts, tables)
            coverage = part.sum(1)
            y = pd.DataFrame({"fields": pd.Series(fields, dtype=object), "error": part[:, 0], "notice": part[:, 1], "filler": part[:, 2], "coverage": coverage})
            y["is_residue"] = (coverage >= COVERAGE) | [bool(f) for f in fields]
            yield pd.concat([x[names].reset_index(drop=True), y], axis=1)

    return chosen.mapInPandas(run, f"{schema}, fields array<string>, error double, notice double, filler double, coverage double, is_residue boolean")
