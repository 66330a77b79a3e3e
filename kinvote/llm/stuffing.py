"""Keyword-stuffed pages and link lists, found by a hidden Markov model over lines.

A page is a sequence of segments: its lines, long ones divided. The model labels
each as prose, link list, tag list, menu or data. A segment is seen as a few
naive features (length, ending, separators, repetition, links) and its words;
the words and features of each label and the passages between labels are
learned from a bounded sample of pages by Viterbi training: clear segments give
the first labels, then the model labels all and is counted again. A page is
stuffed if links and tags make up more than half of the characters of its own
content, which is everything but menus, notices, footers and the title.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinvote.llm.tokens import pieces, spread
from kinvote.sources.scratch import cut

PROSE, LINKS, TAGS, MENU, DATA = range(5)
LABELS = ("prose", "links", "tags", "menu", "data")
K = len(LABELS)

#: Pages that the model is fitted on at most; a sample by hash, whatever the size of the corpus.
FIT_PAGES = 5_000
#: Characters of that sample at most, for corpora of very long pages.
FIT_CHARS = 40_000_000
ROUNDS = 3
#: Words of a segment: longer lines are divided at the ends of sentences, or at twice this length.
SEGMENT = 24

_MARKS = ".,;:!?\"'“”„«»‘’()[]{}<>|/\\•·–—-*_~=+…¿¡&@#%^`"
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@])(?:[\w-]{1,63}\.){1,8}[a-z]{2,24}(?:/\S*)?(?![\w.])", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_ODD = re.compile(r"[^\w'’-]|_")
_SEPARATORS = re.compile(r"[,;|/•·*#>»~]|\s[–—-]\s")
_HASHTAG = re.compile(r"(?:^|\s)#[^\W\d]")
_ARTICLE = re.compile(r"(?:^|\s)(?:#\d+|[A-Za-z]{2,4}[-. ]?\d{2,})(?=\s|$)")
_SPELT = re.compile(r"^(?:\w[.\-_*​ ]){3,}\w?$")

# Classes of words outside the vocabulary.
_RARE, _NUMBER, _MIXED, _LETTER, _ADDRESS, _BROKEN, _LONG, _SPELT_OUT = range(8)
_CLASSES = 8

#: Number of values of every feature.
_SIZES = (7, 2, 3, 4, 3, 5, 2, 3, 3)


# One-byte charsets under which UTF-8 pages are often read by mistake.
_MISREAD = ("cp1252", "latin-1", "koi8-r", "cp1251")


def readable(line: str) -> str:
    """A line that was UTF-8 but read under another charset, put right; any other line as it is."""
    if not line.isascii():
        for charset in _MISREAD:
            try:
                return line.encode(charset).decode("utf-8")
            except UnicodeError:
                pass
    return line


def divided(line: str) -> list[str]:
    """The segments of one line."""
    line = readable(line).strip()
    if line.count(" ") <= 1.5 * SEGMENT:
        return [line] if line else []
    out, words, start = [], line.split(), 0
    for j, word in enumerate(words):
        n = j + 1 - start
        if n >= SEGMENT and (_END.search(word) or n >= 2 * SEGMENT):
            out.append(" ".join(words[start : j + 1]))
            start = j + 1
    if start < len(words):
        out.append(" ".join(words[start:]))
    return out


def segments(text: str) -> list[tuple[int, str]]:
    """(line number, segment) of all lines that hold a word."""
    return [(i, s) for i, line in enumerate(text.split("\n")) for s in divided(line)]


def words_of(segment: str) -> list[str]:
    """Its words in lower case, without marks around them."""
    own = [w.strip(_MARKS) for w in segment.lower().split()]
    return [w for w in own if w]


def _class(word: str) -> int:
    """The class of a word that is not in the vocabulary."""
    if "�" in word:
        return _BROKEN
    if "​" in word or _SPELT.match(word):
        return _SPELT_OUT
    # An address, alone or in the markup of a link: [url=address]text[/url], [text](address), <a href="address">.
    if "." in word and (found := _LINK.search(word)) and (len(found[0]) == len(word) or 2 * len(found[0]) > len(word) and any(c in word for c in "=[](<")):
        return _ADDRESS
    if len(word) > 30:
        return _LONG
    if len(word) <= 1:
        return _LETTER
    if word.isalpha():
        return _RARE
    odd = _ODD.findall(word)
    if any(not c.isascii() for c in odd):
        return _BROKEN
    if odd or _DIGITS.search(word):
        return _NUMBER if not any(map(str.isalpha, word)) else _MIXED
    return _RARE


#: Lower bounds of the values of the features, from the second value on.
_WORDS, _SHARE, _ALIKE, _LINKED, _AGAIN, _TAGGED, _DIGITAL = (2, 3, 4, 6, 9, 15), (0.01, 0.15), (0.5, 0.75), (0.01, 0.42), (0.01, 0.15, 0.35, 0.6), (0.02, 0.12), (0.02, 0.25)


@dataclass
class Page:
    """The segments of a page with their words and features."""

    lines: list[int]
    chars: np.ndarray
    words: list[list[str]]
    features: np.ndarray
    ids: np.ndarray | None = None

    def numbered(self, vocabulary: dict[str, int]) -> np.ndarray:
        """Numbers of all its words in the vocabulary, or of their classes."""
        if self.ids is None:
            get = vocabulary.get
            self.ids = np.array([_class(w) if (i := get(w)) is None else i for own in self.words for w in own], np.int64)
        return self.ids


def page(text: str) -> Page:
    """Cut and describe a text."""
    cut_up = segments(text)
    lines, words, features = [i for i, _ in cut_up], [], np.zeros((len(cut_up), len(_SIZES)), np.int8)
    chars = np.array([len(s) for _, s in cut_up], np.int64)
    pairs: Counter = Counter()
    for _, s in cut_up:
        own = words_of(s)
        words.append(own)
        pairs.update(zip(own, own[1:]))
    for k, ((_, s), own) in enumerate(zip(cut_up, words)):
        n = len(own)
        linked = sum(map(len, _LINK.findall(s))) / len(s) if "." in s else 0.0
        clear = [w for w in own if "�" not in w] if "�" in s else own
        m = len(clear)
        alike = len(set(clear)) / m if m >= 6 else 1.0
        again = sum([pairs[p] >= 3 for p in zip(clear, clear[1:])]) / (m - 1) if m > 1 else 0.0
        numbers = _DIGITS.findall(s)
        tagged = ((len(_HASHTAG.findall(s)) if "#" in s else 0) + (len(_ARTICLE.findall(s)) if numbers else 0)) / max(n, 1)
        features[k] = (
            bisect(_WORDS, n), bool(_END.search(s)), bisect(_SHARE, len(_SEPARATORS.findall(s)) / max(n, 1)),
            3 if n < 6 else bisect(_ALIKE, alike), bisect(_LINKED, linked), bisect(_AGAIN, again), not s[0].islower(),
            bisect(_TAGGED, tagged), bisect(_DIGITAL, sum(map(len, numbers)) / len(s)),
        )
    return Page(lines, chars, words, features)


def _first_labels(p: Page, menus: set[int]) -> list[int]:
    """Labels of the clear segments, -1 for the others."""
    out, leading, n = [], True, len(p.words)
    for k, (own, f) in enumerate(zip(p.words, p.features)):
        length, end, separators, alike, linked, again, _, tagged, digits = f.tolist()
        if (leading or k >= n - 2) and hashed(" ".join(own)) in menus:
            out.append(MENU)
            continue
        leading = False
        if linked == 2:
            out.append(LINKS)
        elif tagged == 2 or (alike == 0 and again >= 3 and length >= 5):
            out.append(TAGS)
        elif any(len(w) > 40 for w in own) or (digits == 2 and length >= 3):
            out.append(DATA)
        elif end and length >= 5 and alike >= 2 and not linked and separators < 2 and again <= 2:
            out.append(PROSE)
        else:
            out.append(-1)
    return out


#: First segments of a page that can be boilerplate, and most words of such a segment.
LEADING, MENU_WORDS = 14, 30
#: Share of all pages that begin or end with a segment of boilerplate.
MENU_SHARE = 0.004


def ends(text: str) -> set[str]:
    """Texts of the short segments that begin a page, and of the last one."""
    out, lines = [], text.split("\n")
    for line in lines:
        out.extend(divided(line))
        if len(out) >= LEADING:
            break
    out = out[:LEADING]
    out.extend(next((own[-1:] for line in reversed(lines) if (own := divided(line))), []))
    return {" ".join(w) for s in out if len(w := words_of(s)) <= MENU_WORDS}


def hashed(segment: str) -> int:
    """64 bits that stand for a segment while all of them are counted."""
    return xxhash.xxh3_64_intdigest(segment) - (1 << 63)


def frequent(pages: int) -> float:
    """Pages that boilerplate is on at least."""
    return max(3, MENU_SHARE * pages)


def menus(documents: DataFrame, text: str = "text") -> set[int]:
    """Hashes of the segments that begin or end at least ``MENU_SHARE`` of all pages of the table.

    Pages count their own segments, so at most (LEADING + 1) / MENU_SHARE
    come out, whatever the size of the corpus. Batches are counted by the
    workers, the rest is one aggregation; null stands for the pages.
    """
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: Counter = Counter()
            for t in pieces(batch.column(text)):
                if t:
                    own.update(map(hashed, ends(t)))
                    own[None] += 1
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), "i8"), pa.array(own.values(), "i8")], schema=to_arrow_schema(schema))

    counts = cut(documents.select(text).mapInArrow(count, schema).groupBy("segment").agg(F.sum("n").alias("n")), "segments")
    pages = counts.where("segment is null").first()
    return {r["segment"] for r in counts.where(F.col("segment").isNotNull() & (F.col("n") >= frequent(pages["n"]))).collect()} if pages else set()


class LineModel:
    """The fitted hidden Markov model."""

    def __init__(self, vocabulary: dict[str, int], words: np.ndarray, features: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> None:
        self.vocabulary, self.words, self.features, self.start, self.moves = vocabulary, words, features, start, moves

    @classmethod
    def fit(cls, texts: Iterable[str], rounds: int = ROUNDS, menus: set[int] | None = None) -> LineModel:
        """Viterbi training from the clear segments of ``texts``; an empty sample gives the prior alone.

        ``menus`` are the hashes of boilerplate segments, by default the frequent ones of ``texts``.
        """
        texts = [t for t in texts if t]
        if menus is None:
            seen = Counter(hashed(s) for t in texts for s in ends(t))
            menus = {s for s, n in seen.items() if n >= frequent(len(texts))}
        pages = [p for p in (page(t) for t in texts if t) if p.words]
        occurs: Counter = Counter()
        for p in pages:
            occurs.update({w for own in p.words for w in own})
        vocabulary = {w: i + _CLASSES for i, w in enumerate(sorted(w for w, n in occurs.items() if n >= 3 and len(w) <= 30 and "�" not in w))}
        labels = [_first_labels(p, menus) for p in pages]
        model = cls._counted(vocabulary, pages, labels)
        for _ in range(rounds):
            model = cls._counted(vocabulary, pages, [model.label(p) for p in pages])
        return model

    @classmethod
    def _counted(cls, vocabulary: dict[str, int], pages: list[Page], labels: list[list[int]]) -> LineModel:
        """Relative frequencies of what the labels show, smoothed."""
        words = np.full((len(vocabulary) + _CLASSES, K), 0.05)
        words[:_CLASSES] += 1.0
        features = [np.full((n, K), 0.5) for n in _SIZES]
        start, moves = np.ones(K), np.ones((K, K)) + np.eye(K) * 4
        for p, own in zip(pages, labels):
            own = np.array(own)
            fixed = own >= 0
            each = np.repeat(own, [len(w) for w in p.words])
            np.add.at(words, (p.numbered(vocabulary)[each >= 0], each[each >= 0]), 1)
            for j, table in enumerate(features):
                np.add.at(table, (p.features[fixed, j], own[fixed]), 1)
            if fixed[0]:
                start[own[0]] += 1
            both = fixed[1:] & fixed[:-1]
            np.add.at(moves, (own[:-1][both], own[1:][both]), 1)
        share = lambda x: np.log(x / x.sum(0))
        table = share(words)
        table[_BROKEN] = 0.0  # what can't be read says nothing
        return cls(vocabulary, table, [share(f) for f in features], np.log(start / start.sum()), np.log(moves / moves.sum(1, keepdims=True)))

    def scores(self, p: Page) -> np.ndarray:
        """Log likelihood of each segment under each label; long segments count less than their words."""
        n = np.array([len(own) for own in p.words])
        sums = np.concatenate([np.zeros((1, K)), np.cumsum(self.words[p.numbered(self.vocabulary)], axis=0)])
        ends = np.cumsum(n)
        seen = sums[ends] - sums[ends - n]
        seen /= np.sqrt(np.maximum(n, 1) / 3.0)[:, None].clip(1)
        for j, table in enumerate(self.features):
            seen += table[p.features[:, j]]
        return seen

    def label(self, p: Page) -> list[int]:
        """The likeliest sequence of labels (Viterbi)."""
        into = self.moves.T.tolist()
        rows = self.scores(p).tolist()
        best, back = [a + b for a, b in zip(self.start.tolist(), rows[0])], []
        for row in rows[1:]:
            ways = [[b + m for b, m in zip(best, own)] for own in into]
            tops = [max(w) for w in ways]
            back.append([w.index(t) for w, t in zip(ways, tops)])
            best = [t + r for t, r in zip(tops, row)]
        out = [best.index(max(best))]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def judge(self, text: str | None) -> tuple[dict[str, int], float]:
        """(characters by label of the own content, share of links and tags in them).

        The title is the first line that is no menu, if it is short, does not
        end like a sentence and more lines follow. A null or empty text, and one of menus only, has share 0.
        """
        chars = np.zeros(K, np.int64)
        p = page(text or "")
        if p.words:
            labels = self.label(p)
            own = [k for k, s in enumerate(labels) if s != MENU]
            titled = len(own) > 1 and p.lines[own[0]] != p.lines[own[1]] and not p.features[own[0]][1]
            body = own[1:] if titled else own
            for k in body:
                chars[labels[k]] += p.chars[k]
            chars[MENU] = sum(int(p.chars[k]) for k, s in enumerate(labels) if s == MENU)
        total = int(chars.sum() - chars[MENU])
        return dict(zip(LABELS, chars.tolist())), (int(chars[LINKS] + chars[TAGS]) / total if total else 0.0)


JUDGED = T.StructType([*(T.StructField(f"{x}_chars", T.LongType()) for x in LABELS), T.StructField("stuffed_share", T.DoubleType())])


def fitted(documents: DataFrame, text: str = "text", pages: int = FIT_PAGES) -> LineModel:
    """A model of a hash sample of at most ``pages`` different texts and ``FIT_CHARS`` characters in all; the boilerplate is counted over all texts.

    Texts are taken in the order of their hash; one that does not fit into the characters that are left is passed over.
    """
    hashed = documents.where(F.length(text) > 0).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    total, chars = hashed.agg(F.count(F.lit(1)), F.sum(F.length("t").cast("long"))).first()
    share = min(1.0, pages / total, FIT_CHARS / chars) if total else 0.0
    bound = F.lit(min(int((2 * share - 1) * 2**63), 2**63 - 1))
    near = cut(hashed.where(F.col("h") <= bound).groupBy("h").agg(F.min("t").alias("t")), "sample")
    # Hashes and lengths of about ``pages`` texts tell which are taken; only those are fetched.
    sizes, left, taken = near.select("h", F.length("t").alias("n")).toArrow().sort_by("h").to_pylist(), FIT_CHARS, []
    for r in sizes:
        if len(taken) < pages and r["n"] <= left:
            taken.append(r["h"])
            left -= r["n"]
    chosen = documents.sparkSession.createDataFrame([(h,) for h in taken], "h long")
    rows = near.join(F.broadcast(chosen), "h").collect() if taken else []
    return LineModel.fit((r["t"] for r in sorted(rows, key=lambda r: r["h"])), menus=menus(documents, text))


def judged(documents: DataFrame, text: str = "text", model: LineModel | None = None) -> DataFrame:
    """``documents`` without ``text`` but with the characters of each label and ``stuffed_share``.

    Every text is read whole. Null and empty texts have no characters and share
    0. Repeated rows are judged alike; an empty table gives an empty result.
    Further columns are kept; those named like an added one are replaced.
    """
    known = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model or fitted(documents, text)))  # some MB at most: the vocabulary of FIT_PAGES pages
    rest = [f for f in documents.schema.fields if f.name != text and f.name.lower() not in JUDGED.names]
    schema = T.StructType([*rest, *JUDGED.fields])
    arrow = to_arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(known.value)
        for batch in batches:
            results = [model.judge(t) for t in pieces(batch.column(text))]
            added = [pa.array([r[0][x] for r in results], "i8") for x in LABELS]
            added.append(pa.array([r[1] for r in results], "f8"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(arrow.field(f.name).type) for f in rest), *added], schema=arrow)

    return documents.mapInArrow(judge, schema)


def stuffed(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``stuffed_share`` of the pages that are stuffed for more than half."""
    return judged(spread(documents.select("doc_id", "text"), "doc_id")).where(F.col("stuffed_share") > 0.5).select("doc_id", "stuffed_share")
