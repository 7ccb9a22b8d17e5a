"""Abusive, hateful or sexual content: FTRL-proximal logistic regression.

Features are hashed word uni-, bi- and trigrams and skip-grams of a line. Before
hashing, spelling is levelled (accents, look-alike letters, zero-width marks,
digits for letters, dotted letters, stretched letters, letters masked by
asterisks, words glued by case or underscores). A document scores as its worst
line: abuse is a sentence among much code. The model is a few thousand non-zero
weights (L1), small enough to broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .hashing import grams, mix, words

#: Letters of other alphabets that look like Latin ones (fixed values).
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdһhкkмmтtвbнnαaεeοoρpτtυuνvκkιißsøołlđdıi"
#: Digits and signs read as letters inside a word (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_MAP: dict[int, str | None] = {ord(a): b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2])}
_MAP |= {ord(a.upper()): b.upper() for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2]) if len(a.upper()) == 1 and ord(a.upper()) > 127}
_MAP |= {c: None for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)}

_C = np.arange(256)
_UPPER = (_C >= 65) & (_C <= 90)
_LOWERED = np.where(_UPPER, _C + 32, _C).astype(np.uint8)
_LETTER = _UPPER | ((_C >= 97) & (_C <= 122))
_DIGIT = (_C >= 48) & (_C <= 57)
_LEET = _C.astype(np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_SAME = np.arange(256, dtype=np.uint8)
_STAR, _NEWLINE = ord("*"), ord("\n")
_JOINT = np.isin(_C, [ord(c) for c in ". -_"])  # between single letters they are dropped
MASKED = np.uint64(0x6D61736B)
_ADDRESS = r"[A-Za-z0-9](?:[\w.+%-]{0,62}\w)?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]\w*"
_MAIL = re.compile(rf"(?<!\w){_ADDRESS}", re.ASCII)
_SIGNED = re.compile(r"^[^\n@]*@[^\n]*", re.MULTILINE)  # the lines with an @
#: A commit's own lines about people (fixed keys): at most five words of name and an address in brackets, or an address, and nothing else.
_HEADER = re.compile(rf"[ \t]*(?:author|commit|committer|from|to|cc|user|[a-z]+(?:-[a-z]+)*-by):[ \t]*(?:(?:[^\s<>@]+[ \t]+){{0,5}}<{_ADDRESS}>|{_ADDRESS})[ \t]*", re.ASCII | re.IGNORECASE)


def level_text(text: str) -> str:
    """Accents off, look-alike letters to Latin, invisible marks away, line ends to \\n."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MAP)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _without_addresses(text: str) -> str:
    """Mail addresses off, and the lines of commit headers and trailers that hold a name and an address only."""
    if "@" not in text:
        return text
    return _SIGNED.sub(lambda m: "" if _HEADER.fullmatch(m[0]) else _MAIL.sub(" ", m[0]), text)


def _shift(m: np.ndarray, by: int) -> np.ndarray:
    """m[i + by], False beyond the ends."""
    out = np.zeros_like(m)
    if by > 0:
        out[:-by] = m[by:]
    else:
        out[-by:] = m[:by]
    return out


def line_features(texts: list[str], bits: int, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(feature, line, text number of each line, with ``hashed`` the hash of each line).

    feature and line run in parallel, one entry per feature; lines count from 0
    over all texts, in order; every text has at least one line. Mail addresses
    have no features, nor has a header line that only names a person
    (``Author: Name <address>``, ``Signed-off-by: ...``).
    """
    parts = [_without_addresses(level_text(t)).encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    size = np.array([len(p) + 1 for p in parts], np.int64)
    first = np.r_[0, np.cumsum(size)]
    low = _LOWERED[raw]
    letter = _LETTER[raw]
    alnum = letter | _DIGIT[raw] | (raw >= 128)
    again = np.zeros(len(raw), bool)
    again[1:] = (low[1:] == low[:-1]) & letter[1:]
    stretched = again & (_shift(again, -1) | _shift(again, 1))
    dot = _JOINT[raw] & _shift(letter, -1) & ~_shift(alnum, -2) & _shift(letter, 1) & ~_shift(alnum, 2)
    keep = ~(stretched | dot)
    raw, low, letter = raw[keep], low[keep], letter[keep]
    moved = np.r_[0, np.cumsum(keep)]
    first = moved[first]
    star = raw == _STAR
    left = _shift(letter, -1) | (_shift(star, -1) & _shift(letter, -2))
    right = _shift(letter, 1) | (_shift(star, 1) & _shift(letter, 2))
    star &= left & right
    sign = ((raw == ord("@")) | (raw == ord("$"))) & _shift(letter, -1) & _shift(letter, 1)
    digit = _DIGIT[raw]
    word = np.where(letter | digit | star | sign | (raw >= 128), low, 0).astype(np.uint8)
    # digits become letters in words that have letters, and one same digit elsewhere
    inside = word != 0
    begin = inside & ~_shift(inside, -1)
    s = np.flatnonzero(begin)
    if len(s):
        used = np.flatnonzero(inside)
        which = np.searchsorted(used, s)
        length = np.diff(np.r_[which, len(used)])
        mixed = np.repeat(np.add.reduceat(letter[used].astype(np.int64), which) > 0, length)
        word[used] = np.where(mixed, _LEET[word[used]], np.where(digit[used], ord("0"), word[used]))
        upper = _UPPER[raw]
        lower = letter & ~upper
        turn = used[upper[used] & (_shift(lower, -1)[used] | (_shift(upper, -1)[used] & _shift(lower, 1)[used]))]
    else:
        turn = s
    newline = np.flatnonzero(raw == _NEWLINE)
    line_start = np.r_[0, newline[:-1] + 1]
    mark = np.zeros(len(raw) + 1, bool)
    mark[line_start] = mark[turn] = mark[len(raw)] = True
    cuts = np.flatnonzero(mark)
    start, _, h, _ = words(word, cuts, _SAME)
    stars = np.flatnonzero(word == _STAR)
    if len(stars):
        h = h.copy()
        h[np.searchsorted(start, stars, side="right") - 1] = MASKED
    line = (np.cumsum(raw == _NEWLINE) - (raw == _NEWLINE))[start]
    mask = np.uint64((1 << bits) - 1)
    feats, lines = [h & mask], [line]
    for kind, (gap, n) in enumerate([(1, 2), (1, 3), (2, 2), (3, 2)]):
        reach = gap * (n - 1)
        if len(h) <= reach:
            continue
        same = line[:-reach] == line[reach:]
        g = grams(h, 3) if n == 3 else mix(h[:-reach] * np.uint64(2 * kind + 3) + h[reach:])
        feats.append((mix(g + np.uint64(kind + 1)) & mask)[same])
        lines.append(line[:-reach][same])
    sums = np.zeros(len(line_start), np.uint64) if hashed else None
    if hashed:
        np.add.at(sums, line, mix(h + (np.arange(len(h)) - np.searchsorted(line, line)).astype(np.uint64)))
    doc = np.searchsorted(first, line_start, side="right") - 1
    return np.concatenate(feats).astype(np.int64), np.concatenate(lines), doc, sums


@dataclass(frozen=True)
class ToxicParams:
    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.15
    l2: float = 0.5
    epochs: int = 4
    batch_lines: int = 16
    folds: int = 5  # the documents are judged by models trained without their fold
    doubt: float = 0.3  # positive documents whose worst line scores less are taken as mislabelled
    lift: float = 4.0  # a feature tells of abuse only if positive documents have it so many times oftener than all documents (less where abuse is common)
    dropout: float = 0.4  # share of the features hidden at each step of the training
    max_labelled: int = 20_000  # labelled documents used, the first by hash of the id
    max_characters: int = 30_000_000  # of these documents together, the first in the same order
    max_terms: int = 10_000  # distinct flag terms that the driver takes; more are an error
    threshold: float = 0.5


class Ftrl:
    """FTRL-proximal: per-coordinate rates, weights exactly zero under the L1 limit."""

    def __init__(self, p: ToxicParams):
        self.p = p
        self.z = np.zeros((1 << p.bits) + 1)
        self.n = np.zeros((1 << p.bits) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n, p = self.z[i], self.n[i], self.p
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def step(self, feature: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        bias = len(self.z) - 1
        feature = np.r_[feature, np.full(len(label), bias)]
        row = np.r_[row, np.arange(len(label))]
        i, back = np.unique(feature, return_inverse=True)
        w = self.weights(i)
        score = np.bincount(row, w[back], len(label))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) * weight
        g = np.bincount(back, error[row], len(i))
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.p.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _line_scores(w: np.ndarray, feature: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(line, w[feature], n) + w[-1], -30, 30)))


def _document_counts(feature: np.ndarray, line: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each pair once."""
    pairs = np.sort((doc[line] << bits) | feature)  # faster than unique, which hashes
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _oftener(pos_df: np.ndarray, neg_df: np.ndarray, labels: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """Which features positive documents have much oftener than all documents.

    Lift is the ratio of both rates; ``least`` is asked of it. How high it can
    get depends on how rare abuse is: where even the best features - the upper
    tenth of those that several positive and no negative documents have - reach
    little, 0.6 of that is asked.
    """
    lift = pos_df / labels.sum() / np.maximum(often, 1e-12)
    best = lift[(pos_df >= 3) & (neg_df == 0)]
    return (pos_df > 0) & (lift >= (min(least, 0.6 * float(np.quantile(best, 0.9))) if len(best) else 1.0))


@dataclass(frozen=True)
class Labelled:
    """Features of the labelled documents and in how many positive and negative ones each is."""

    feature: np.ndarray
    line: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    pos_df: np.ndarray
    neg_df: np.ndarray
    odds: np.ndarray  # log odds of a feature over those of the labels; 0 if it is in a single positive document only

    @property
    def doubled(self) -> np.ndarray:
        """Features whose odds are at least twice those of the labels."""
        return self.odds > np.log(2)

    @staticmethod
    def of(texts: list[str], labels: np.ndarray, bits: int) -> Labelled:
        parts, lines, docs = [], 0, 0
        for some in _chunks(texts):  # bounds the memory that bytes take while they are taken apart
            f, at, d, h = line_features(some, bits, hashed=True)
            parts.append((f, at + lines, d + docs, h))
            lines, docs = lines + len(d), docs + len(some)
        feature, line, doc, key = (np.concatenate([x[i] for x in parts]) for i in range(4))
        in_doc, has = _document_counts(feature, line, doc, bits)
        pos_df = np.bincount(has[labels[in_doc] == 1], minlength=1 << bits)
        neg_df = np.bincount(has[labels[in_doc] == 0], minlength=1 << bits)
        odds = np.log((pos_df + 0.1) / (neg_df + 0.3)) - np.log(labels.sum() / (labels == 0).sum())
        return Labelled(feature, line, doc, key, pos_df, neg_df, np.where(pos_df >= min(2, labels.sum()), odds, 0.0))


def train(texts: list[str], labels: np.ndarray, terms: list[str], p: ToxicParams, often: np.ndarray | None = None, known: Labelled | None = None) -> np.ndarray:
    """Dense weights (the bias last) from labelled documents.

    Only the document is labelled, not the line: in a positive document the line
    found worst stands for it. First that is the line whose features most prefer
    positive documents (``terms`` add to that); a model trained on each half of
    the documents then judges the other half. The line it finds worst takes
    over. A positive document in which it finds nothing counts as mislabelled
    unless the first choice has a term that no negative document has, or
    a feature that negative ones all but lack; so does a negative line it flatly contradicts. The final
    model is trained on the rest.

    ``often`` has the share of all documents with each feature. A line stands
    for a positive document only if it has a term or a feature that positive
    documents have much oftener than all documents: what few labelled negative
    documents happen to lack may yet be common. ``known`` are the documents'
    features where the caller has them.
    """
    if not len(texts) or not labels.any() or labels.all():
        return np.r_[np.zeros(1 << p.bits), -10.0]
    k = known or Labelled.of(texts, labels, p.bits)
    feature, line, doc, key, pos_df, neg_df = k.feature, k.line, k.doc, k.key, k.pos_df, k.neg_df
    n_lines = len(doc)
    positive = labels[doc].astype(bool)
    rare = k.odds > 0 if often is None else k.doubled & _oftener(pos_df, neg_df, labels, often, p.lift)
    odds = np.where(rare, k.odds, 0.0)
    flagged = np.zeros(1 << p.bits, bool)
    if terms:
        flagged[line_features(terms, p.bits)[0]] = True
    odds[flagged] += 1.5
    lead = np.maximum(odds, 0) * np.sqrt(pos_df + 1)
    score = 0.01 * np.bincount(line, lead[feature], n_lines)
    np.maximum.at(score, line, lead[feature])
    telling = np.bincount(line, ((flagged & (neg_df == 0)) | ((pos_df >= 3) & (20 * neg_df <= pos_df)))[feature], n_lines) > 0
    backed = np.bincount(line, (rare | flagged)[feature], n_lines) > 0
    if often is None:
        backed[:] = True
    telling &= backed
    order = np.argsort(line, kind="stable")
    feature_by, starts = feature[order], np.searchsorted(line[order], np.arange(n_lines + 1))
    # one line stands for all negative lines that read the same
    neg = np.flatnonzero(~positive)
    _, pick, count = np.unique(key[neg], return_index=True, return_counts=True)
    common = np.isin(key, key[neg[pick]][count > 1]) & positive  # lines that several negative lines read like
    neg, neg_weight, once = neg[pick], np.log2(1 + count), count == 1
    first, last = np.searchsorted(doc, np.flatnonzero(labels == 1)), np.searchsorted(doc, np.flatnonzero(labels == 1), side="right")

    def worst(score: np.ndarray) -> np.ndarray:
        score = np.where(common | ~backed, score * 1e-3, score)
        return np.array([a + int(np.argmax(score[a:b])) for a, b in zip(first, last)])

    def run(pos: np.ndarray, neg: np.ndarray, neg_weight: np.ndarray) -> np.ndarray:
        rows, y = np.r_[pos, neg], np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        weight = np.r_[np.ones(len(pos)), neg_weight]
        shuffle = np.argsort(mix(key[rows] + np.arange(len(rows)).astype(np.uint64)))
        rows, y, weight = rows[shuffle], y[shuffle], weight[shuffle]
        model, hidden = Ftrl(p), np.uint64(int(p.dropout * 2**64))
        for epoch in range(p.epochs):
            for a in range(0, len(rows), p.batch_lines):
                r = rows[a : a + p.batch_lines]
                length = starts[r + 1] - starts[r]
                at = np.repeat(starts[r] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                row = np.repeat(np.arange(len(r)), length)
                shown = mix(feature_by[at].astype(np.uint64) + np.uint64(a * 64 + epoch)) >= hidden
                model.step(feature_by[at][shown], row[shown], y[a : a + p.batch_lines], weight[a : a + p.batch_lines])
        return model.weights(slice(None))

    best, fold = worst(score), doc % p.folds
    judged = np.zeros(n_lines)
    for k in range(p.folds):
        w = run(best[fold[best] != k], neg[fold[neg] != k], neg_weight[fold[neg] != k])
        judged = np.where(fold == k, _line_scores(w, feature, line, n_lines), judged)
    found = worst(judged)
    best = np.where(judged[found] >= p.doubt, found, best)
    keep_pos = ((judged[best] >= p.doubt) | telling[best]) & backed[best]
    keep_neg = ~((judged[neg] > 0.9) & once)
    return run(best[keep_pos], neg[keep_neg], neg_weight[keep_neg])


def feature_shares(documents: DataFrame, wanted: np.ndarray, p: ToxicParams) -> np.ndarray:
    """Share of all documents with a text that have each of the ``wanted`` features (a mask; others are 0).

    One pass over all texts. A task emits a count per wanted feature it met, so
    at most 2^bits sums reach the driver whatever the corpus.
    """
    sent = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            for texts in _chunks(batch.column(0).to_pylist()):
                rows += len(texts)
                feature, line, doc, _ = line_features(texts, p.bits)
                known = sent.value[feature]
                total += np.bincount(_document_counts(feature[known], line[known], doc, p.bits)[1], minlength=1 << p.bits)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, met]), pa.array(np.r_[rows, total[met]])], names=["feature", "n"])

    rows = documents.filter("text IS NOT NULL").select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(1 << p.bits), 0
    for r in rows:
        if r.feature < 0:
            n = r.n
        else:
            out[r.feature] = r.n
    return out / max(n, 1)


def fit(documents: DataFrame, labels: DataFrame, terms: DataFrame, p: ToxicParams) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) of the non-zero weights.

    At most ``max_labelled`` labelled documents are used (those first by hash of
    their id), of at most ``max_characters`` together: a bound on what reaches
    the driver. Contradicting labels of a
    document are settled by majority; a tie, a NULL label or a NULL text is
    left out. How often features are in all documents is counted over all of
    them. All distinct ``terms`` are used; more than ``max_terms`` are a
    ValueError. Without both kinds of label every document scores about 0.
    """
    votes = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("share"))
    votes = votes.filter("share <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    joined = documents.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(votes), "doc_id")
    sized = materialise(joined.select("doc_id", "share", F.length("text").alias("size"), F.xxhash64("text").alias("h"), "text"), "labelled")
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    within = sized.select("doc_id", "h", "size").withColumn("_upto", before).filter(F.col("_upto") <= p.max_characters).select("doc_id", "h").distinct()
    rows = sorted((r.doc_id, r.text, r.share) for r in sized.join(F.broadcast(within), ["doc_id", "h"]).select("doc_id", "text", "share").collect())
    known = sorted(r.term for r in terms.filter("term IS NOT NULL").select("term").distinct().limit(p.max_terms + 1).collect())
    if len(known) > p.max_terms:
        raise ValueError(f"more than {p.max_terms} distinct terms")
    texts, toxic = [r[1] for r in rows], np.array([int(r[2] > 0.5) for r in rows], int)
    often = parts = None
    if toxic.any() and not toxic.all():
        parts = Labelled.of(texts, toxic, p.bits)
        often = feature_shares(documents, parts.doubled, p)
    w = train(texts, toxic, known, p, often, parts)
    used = np.flatnonzero(w[:-1])
    return used.astype(np.int32), w[used].astype(np.float32), float(w[-1])


def _chunks(texts: list[str | None], chunk: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in groups of about ``chunk`` characters; NULL is empty."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= chunk:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_documents(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: ToxicParams, chunk: int = 1 << 20) -> DataFrame:
    """(doc_id, source, score): the probability of each document's worst line.

    Every row of ``documents`` comes out, repeated ids too; an empty or NULL text
    scores as an empty line. The sparse weights travel as one broadcast of at
    most 2^bits entries; no shuffle. Texts are worked on in groups of about ``chunk`` characters.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weight, bias = sent.value
        w = np.zeros((1 << p.bits) + 1)
        w[used], w[-1] = weight, bias
        for batch in batches:
            out: list[np.ndarray] = []
            for texts in _chunks(batch.column(2).to_pylist(), chunk):
                feature, line, doc, _ = line_features(texts, p.bits)
                lines = _line_scores(w, feature, line, len(doc))
                out.append(np.maximum.reduceat(lines, np.searchsorted(doc, np.arange(len(texts)))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(np.concatenate(out))], schema=rows)

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")
