"""Evaluation texts leaking into training text: an FM-index of each shard, searched backward for the phrases of all test items."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.llm.lookalikes import BLANKS, CYRILLIC, GREEK, INVISIBLE

#: A leak has at least WORDS words of an item in a row, of which one in EDIT_RATE may be changed, dropped or added.
WORDS, EDIT_RATE = 15, 6
#: Words of a phrase that is searched for, and how many phrases of an item every leak keeps: an edit touches PHRASE of them.
PHRASE = 3
NEAR = WORDS - PHRASE + 1 - PHRASE * (WORDS // EDIT_RATE)
#: Characters of the items of one block, each broadcast on its own, and of the documents of one shard.
BLOCK, SHARD = 8_000_000, 8_000_000
#: Every so many places of a shard have their text place stored.
SAMPLE = 8

_fold = str.maketrans({**CYRILLIC, **GREEK, "ς": "σ"})
_hidden = re.compile(f"[{INVISIBLE}]")
_blanks = re.compile(f"[{BLANKS} \n]+")
_dash = "-‐-―−﹘﹣－"
_broken = re.compile(rf"(?<=\w)[{_dash}][{BLANKS} ]*\n[{BLANKS} \n]*(?=\w)")
_inner = re.compile(rf"(?<=\w)[{_dash}'’](?=\w)")
_split = re.compile(r"(?<=[^\W\d_])[.,;:!?…)”\"»](?=[^\W\d_])|—|–|/")
_other = re.compile(r"[\W_]+")
_cluster = regex.compile(r"\X")
_token = re.compile(f"[^{BLANKS} \n]+")


#: Words of a token between blanks; emptied at _KNOWN entries, so it only saves time.
_known: dict[str, tuple[str, ...]] = {}
_KNOWN = 500_000


def _plain(text: str) -> str:
    """``text`` without invisible characters, in compatibility form, with words that a hyphen breaks at a line end joined."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _hidden.sub("", text))
    return _broken.sub("", text) if "\n" in text else text


def _words_of_token(token: str) -> tuple[str, ...]:
    words = _split.sub(" ", _inner.sub("", token).translate(_fold).lower()).split(" ")
    return tuple(w for x in words if (w := _other.sub("", x)))


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, look-alikes, invisible characters and breaks within words; what has no letter or digit is no word."""
    if len(_known) > _KNOWN:
        _known.clear()
    out: list[str] = []
    for token in _blanks.split(_plain(text)):
        if (words := _known.get(token)) is None:
            words = _known[token] = _words_of_token(token)
        out += words
    return out


def word_places(text: str) -> list[tuple[int, int]]:
    """[begin, end) in ``text`` as stored, in code points, of each of its words_of()."""
    seen = [i for i, c in enumerate(text) if not _hidden.match(c)]
    bare = "".join(text[i] for i in seen)
    chars, at = [], []
    for m in _cluster.finditer(bare):
        new = unicodedata.normalize("NFKC", m.group())
        chars.append(new)
        at += [(seen[m.start()], seen[m.end() - 1] + 1)] * len(new)
    plain = "".join(chars)
    broken = [m.span() for m in _broken.finditer(plain)]
    gone = set().union(*(range(*x) for x in broken)) if broken else ()
    kept = [i for i in range(len(plain)) if i not in gone]
    whole = "".join(plain[i] for i in kept)
    out: list[tuple[int, int]] = []
    for token in _token.finditer(whole):
        own = list(range(*token.span()))
        inner = {m.start() for m in _inner.finditer(token.group())}
        letters = [(c, i) for k, i in enumerate(own) if k not in inner for c in whole[i].translate(_fold)]
        lower = [(x, i) for c, i in letters for x in c.lower()]
        cut = {m.start() for m in _split.finditer("".join(x for x, _ in lower))}
        word: list[int] = []
        for k, (x, i) in enumerate([*lower, (" ", -1)]):
            if k in cut or x == " ":
                if word:
                    out.append((at[kept[word[0]]][0], at[kept[word[-1]]][1]))
                word = []
            elif not _other.match(x):
                word.append(i)
    return out


class WaveletMatrix:
    """Rank queries on a sequence of symbols, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        seq = symbols
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(seq) - int(self.levels[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(place), place.copy()
        for i, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            l1, h1 = ones[low], ones[high]
            low = np.where(bit, zeros + l1, low - l1)
            high = np.where(bit, zeros + h1, high - h1)
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbols at some places."""
        at, out = place.copy(), np.zeros_like(place)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling; places already told apart are not sorted again."""
    n = len(symbols)
    codes = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    high = int(codes.max()) + 2
    step = 3 if high < 1 << 20 else 1
    key = codes + 1
    for k in range(1, step):
        key = key * high
        key[:-k or None] += codes[k:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    slot = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), slot, 0))
    while True:
        first = rank[order]
        tied = np.zeros(n, dtype=bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        slot = np.nonzero(tied)[0]
        if not len(slot):
            return order
        some = order[slot]
        follow = some + step
        key = rank[some] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        some, key = some[sort], key[sort]
        order[slot] = some
        rank[some] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), slot, 0))
        step *= 2


class FMIndex:
    """An FM-index of a sequence of positive symbols below ``sigma``."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.concatenate((symbols.astype(np.int64), [0]))
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = WaveletMatrix(bwt, sigma)
        self.n = len(text)
        marked = order % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the rows whose suffixes begin with each phrase (a row of symbols), by backward search."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low = self.before[symbol] + self.tree.rank(symbol, low)
            high = self.before[symbol] + self.tree.rank(symbol, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of some rows: steps back to the next sampled place."""
        rows, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            known = self.marks[at + 1] > self.marks[at]
            done = left[known]
            out[done] = self.samples[self.marks[rows[done]]] + steps[done]
            left = left[~known]
            symbol = self.tree.access(rows[left])
            rows[left] = self.before[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return out % self.n


def held(item: list[str], part: list[str]) -> list[tuple[int, int, int]]:
    """(begin, end, words): the places [begin, end) of ``part`` that hold at least WORDS words of ``item`` in a row with at most one in EDIT_RATE changed, dropped or added.

    The texts are aligned with fewest edits; the longest stretch of the alignment with few enough edits counts, then the
    longest before and behind it, and so on. A stretch begins and ends with a word that is held.
    """
    n, m = len(item), len(part)
    cost = np.zeros((n + 1, m + 1), dtype=np.int32)
    cost[:, 0] = np.arange(n + 1)
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([codes.setdefault(w, len(codes)) for w in part])
    across = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, dtype=np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(row - across) + across
    steps: list[tuple[int, int, int]] = []  # (words of the item, edits, place in the part) from the end
    i, j = n, int(np.argmin(cost[n]))
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            steps.append((1, int(a[i] != b[j]), j))
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            steps.append((1, 1, j))
        else:
            j -= 1
            steps.append((0, 1, j))
    steps.reverse()
    length = np.concatenate(([0], np.cumsum([s[0] for s in steps])))
    score = length - EDIT_RATE * np.concatenate(([0], np.cumsum([s[1] for s in steps])))
    same = np.array([s[:2] == (1, 0) for s in steps])
    out, open_ = [], [(0, len(steps))]
    while open_:
        low, high = open_.pop()
        best = (0, 0, 0)
        if length[high] - length[low] < WORDS:
            continue
        for x in low + np.nonzero(same[low:high])[0]:
            good = np.nonzero(same[x:high] & (score[x + 1 : high + 1] >= score[x]))[0]
            if len(good):
                best = max(best, (int(length[x + 1 + good[-1]] - length[x]), -int(x), int(x + 1 + good[-1])))
        if best[0] >= WORDS:
            begin, end = -best[1], best[2]
            out.append((steps[begin][2], steps[end - 1][2] + 1, best[0]))
            open_ += [(low, begin), (end, high)]
    return sorted(out)


class Items:
    """Test items by word, with the distinct phrases of PHRASE words and the places that each has in them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = [(i, w) for i, t in items if t and len(w := words_of(t)) >= WORDS]
        codes: dict[str, int] = {}
        rows = [(k, p, [codes.setdefault(x, len(codes)) for x in w[p : p + PHRASE]]) for k, (_, w) in enumerate(self.words) for p in range(len(w) - PHRASE + 1)]
        self.vocabulary = list(codes)
        phrases = np.array([r[2] for r in rows], dtype=np.int64).reshape(-1, PHRASE)
        self.phrases, back = np.unique(phrases, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        self.uses = np.array([(r[0], r[1]) for r in rows], dtype=np.int64).reshape(-1, 2)[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(back.ravel(), minlength=len(self.phrases)))))


class Shard:
    """An FM-index over the words of some texts, each once; it knows nothing of the items, so any number of blocks is searched in it."""

    def __init__(self, docs: list[tuple[int, str]]):
        copies: dict[str, list[int]] = {}
        for doc, text in docs:
            copies.setdefault(text, []).append(doc)
        self.texts, self.docs = list(copies), list(copies.values())
        self.words = [words_of(t) for t in self.texts]
        self.codes: dict[str, int] = {}
        code = self.codes.setdefault
        symbols: list[int] = []
        for words in self.words:
            symbols += [code(w, len(self.codes) + 2) for w in words]
            symbols.append(1)  # parts texts
        self.begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in self.words])))
        self.index = FMIndex(np.array(symbols, dtype=np.int64), len(self.codes) + 2) if symbols else None

    def leaks(self, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, doc_id, begin, end, words) of the items in the texts, with the characters [begin, end) that hold them."""
        if self.index is None or not len(items.phrases):
            return
        codes = np.array([self.codes.get(w, 0) for w in items.vocabulary], dtype=np.int64)[items.phrases]
        known = np.nonzero((codes > 0).all(axis=1))[0]  # a word that no text has can't be found
        low, high = self.index.search(codes[known])
        some = high > low
        hit, low, sizes = known[some], low[some], (high - low)[some]
        if not len(hit):
            return
        rows = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        phrase, found = np.repeat(hit, sizes), self.index.locate(rows)
        uses = items.first[phrase + 1] - items.first[phrase]
        use = np.repeat(items.first[phrase], uses) + np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
        at = np.repeat(found, uses)
        owner = np.searchsorted(self.begins, at, side="right") - 1
        pair, spot = items.uses[use, 0] * len(self.texts) + owner, at - self.begins[owner]
        order = np.lexsort((spot, pair))
        pair, spot, p = pair[order], spot[order], items.uses[use, 1][order]
        edges = np.concatenate(([0], np.nonzero(pair[1:] != pair[:-1])[0] + 1, [len(pair)]))
        places: dict[int, list[tuple[int, int]]] = {}
        for x in np.nonzero(np.diff(edges) >= NEAR)[0]:
            part = slice(edges[x], edges[x + 1])
            item_id, item = items.words[pair[part.start] // len(self.texts)]
            k = int(pair[part.start] % len(self.texts))
            for begin, end, n in _spans(item, self.words[k], spot[part], p[part]):
                at_ = places[k] if k in places else places.setdefault(k, word_places(self.texts[k]))
                for doc in self.docs[k]:
                    yield int(item_id), doc, at_[begin][0], at_[end - 1][1], n


def _spans(item: list[str], words: list[str], spots: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, words) of the leaks of an item in a document, of whose phrases ``p`` were found at ``spots``, as words [begin, end); of spans that overlap the longest."""
    found: list[tuple[int, int, int]] = []
    tried = set()
    slack = len(item) // EDIT_RATE + 2
    shift = spots - p
    for base in np.unique(shift // slack):
        near = np.abs(shift - (base * slack + slack // 2)) <= 2 * slack
        if len(np.unique(p[near])) < NEAR:
            continue
        span = max(0, int(shift[near].min()) - slack), min(len(words), int(shift[near].max()) + len(item) + slack)
        if span not in tried:
            tried.add(span)
            found += [(span[0] + a, span[0] + b, n) for a, b, n in held(item, words[span[0] : span[1]])]
    out: list[tuple[int, int, int]] = []
    for begin, end, n in sorted(found, key=lambda x: (-x[2], x)):
        if all(end <= a or b <= begin for a, b, _ in out):
            out.append((begin, end, n))
    return sorted(out)


_LEAKS = "item_id bigint, doc_id bigint, begin int, end int, words int"


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``chars`` characters; the driver holds one block at a time."""
    known = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    block, size = [], 0
    for r in known.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _shards(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[list[tuple[int, str]]]:
    docs, size = [], 0
    for b in batches:
        for doc, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
            docs.append((doc, text))
            size += len(text)
            if size >= chars:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(item_id, doc_id, begin, end, words): the items that each document holds in whole or part, each place of an item apart, at the characters [begin, end) of the text as stored.

    Each stretch of documents of about ``shard`` characters has an index of its own words, built once; no document is
    moved. The items are broadcast in blocks of about ``block`` characters, and all blocks are searched in an index
    while it stands. Null and empty texts hold nothing; items of under WORDS words can't leak; of repeated rows one counts.
    """
    context = documents.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in _blocks(items, block)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = Items(shared[0].value) if len(shared) == 1 else None
        for docs in _shards(batches, shard) if shared else ():
            index = Shard(docs)
            for x in shared:
                rows = index.leaks(only or Items(x.value))
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "begin", "end", "words"])
                if only is None:
                    vars(x).pop("_value", None)  # a worker holds one block at a time

    return documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text").mapInPandas(run, _LEAKS).distinct()


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, begin, end, items): the spans of characters to be removed from each document, those that meet as one."""
    by_doc = Window.partitionBy("doc_id").orderBy("begin", "end", "item_id")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)).withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.countDistinct("item_id").alias("items")).drop("run")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` whose leaks are cut out of the text; a document without leaks stays as it is."""
    spans = removal_spans(found).groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__spans"))
    kept = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["t"], F.substring(F.col("text"), a["at"] + 1, s["begin"] - a["at"])).alias("t"), s["end"].alias("at")),
        lambda a: F.concat(a["t"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    joined = documents.join(spans, F.col("doc_id") == F.col("__doc"), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)).drop("__doc", "__spans")
