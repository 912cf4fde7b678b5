"""Hierarchical language identification.

The family of a text is predicted first (one linear support vector machine for
each pair of families), then its language by one-versus-one machines inside that
family. Features are relative frequencies of hashed letter n-grams (1 to 3
bytes) over the whole text; letters are A-Z folded to lower case and all
non-ASCII bytes, anything else is one gap.

Learning uses at most ``sample_per_language`` labelled documents of each
language (chosen by a hash of doc_id, of the text where that is null) and nothing but their text and lang. Tasks make the
sample's features and one more task learns from them, in the order of that hash,
so neither partitions nor runs change the result; it keeps the features sparse
and makes a matrix of one machine's rows at a time. The driver gets the finished
model only, which has a fixed size and is sent to the executors whole.

Where rejection is asked for (``train(docs, reject=True)``), one more machine a
language parts it from noise. Noise is made from at most ``noise_per_language``
of the sampled documents: letters drawn at random, the document's own letters in
random order, letters of another script, random digits and letters as in codes.
A text is rejected when the machine of its predicted language puts it further to
the noise side than nearly all clean rows of that language and of about its
length lie (pieces of one word and more are among them, so short texts are
rejected on strong evidence only).

A text's score is the smallest logistic of the margins that decided for its
family and its language, so it lies between 0.5 and 1 on a clear path; ``und``
has score 0.

Defined results: a text that is null, empty or has no letter is ``und``; with no
labelled rows everything is ``und``, and an empty table gives an empty result;
with one language every text with a letter gets it, at score 1. Languages that
FAMILIES does not list are families of their own. Very long texts are read whole,
a slice at a time; equal texts get equal answers; ties between classes go to the
later one by name. ``identify`` reads doc_id and text, ``keep_identified`` passes all
columns through, so no names clash.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Language families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
SAMPLE_PER_LANGUAGE = 500
#: Sampled documents of each language that noise and short pieces are made of.
NOISE_PER_LANGUAGE = 60
#: A length's floor lies so many spreads (median to lower sixth of the margins) below the median; a few mislabelled rows don't move it.
SPREADS = 6.0
#: No text is rejected above this margin, so the noise machine must be sure.
HIGHEST_FLOOR = -1.0
BITS, LONGEST = 12, 3
BUCKETS = 1 << BITS
UNKNOWN = "und"
SLICE = 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_FOLD = np.where(_LETTER, tokens.LOWER, ord(" ")).astype(np.uint8)
_STEP = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _gram_counts(folded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams (rows: texts); no n-gram reaches into another text."""
    n = len(at) - 1
    pad = LONGEST - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    wide = np.full(len(folded) + pad * (n + 1), ord(" "), dtype=np.uint32)
    place = np.arange(len(folded)) + pad * owner
    wide[place] = folded
    base = owner * BUCKETS
    out = np.zeros(n * BUCKETS, dtype=np.int64)
    h = np.zeros(len(wide), dtype=np.uint32)
    for k in range(LONGEST):
        end = len(wide) - k
        h[:end] += wide[k:] * _STEP[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(base + (h[place] >> np.uint32(32 - BITS)), minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def _clean(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with every run of other bytes as one space, and the new offsets."""
    folded = _FOLD[raw]
    gap = folded == ord(" ")
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[at[:-1][at[:-1] < len(raw)]] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of relative n-gram frequencies, a row for each text."""
    counts = np.zeros((len(at) - 1, BUCKETS), dtype=np.int64)
    if at[-1] - at[0] <= SLICE or len(at) > 2:
        counts += _gram_counts(*_clean(raw[at[0] : at[-1]], at - at[0]))
    else:  # one very long text, a slice at a time
        for lo in range(int(at[0]), int(at[-1]), SLICE):
            part = raw[lo : min(lo + SLICE, int(at[-1]))]
            counts += _gram_counts(*_clean(part, np.array([0, len(part)])))
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)), dtype=np.float32)


def _groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE bytes together and 64 texts; a longer text is a run of its own."""
    lo = 0
    while lo < len(at) - 1:
        hi = lo + 1
        while hi < len(at) - 1 and hi - lo < 64 and at[hi + 1] - at[lo] <= SLICE:
            hi += 1
        yield lo, hi
        lo = hi


def has_letter(raw: np.ndarray) -> bool:
    """Any letter of any script; only texts without A-Z need decoding."""
    if (_LETTER[raw] & (raw < 0x80)).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


class Sample:
    """Sparse feature rows; the rows that an index picks come as a new dense matrix."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]):
        self.places, self.values = places, values

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        spots = self._numbers(rows)
        out = np.zeros((len(spots), BUCKETS), dtype=np.float32)
        for i, k in enumerate(spots):
            out[i, self.places[k]] = self.values[k]
        return out

    def only(self, rows: np.ndarray) -> Sample:
        spots = self._numbers(rows)
        return Sample([self.places[k] for k in spots], [self.values[k] for k in spots])

    @staticmethod
    def _numbers(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero(rows) if rows.dtype == bool else rows


class Svm:
    """A linear machine between two classes: squared hinge loss, accelerated full-batch gradient.

    ``x`` is given away: it is centred in place.
    """

    def __init__(self, x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, rounds: int = 150):
        y = np.where(positive, 1.0, -1.0).astype(np.float32)
        share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
        self.mean = share @ x
        z = np.subtract(x, self.mean, out=x)
        w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
        rate = 1.0 / (2 * (float(share @ np.einsum("ij,ij->i", z, z)) + 1.0) + penalty)
        for k in range(rounds):
            slack = np.maximum(0.0, 1.0 - y * (z @ v + np.float32(vb)))
            pull = share * slack * y
            nw, nb = v + np.float32(rate) * (2 * (pull @ z) - np.float32(penalty) * v), vb + rate * 2 * float(pull.sum())
            speed = k / (k + 3)
            v, vb, w, b = nw + np.float32(speed) * (nw - w), nb + speed * (nb - b), nw, nb
        spread = float(np.sqrt(share @ np.square(z @ w + np.float32(b)))) or 1.0
        self.weight, self.bias = w.astype(np.float64) * (4.0 / spread), b * (4.0 / spread)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weight + self.bias


class Vote:
    """One-versus-one machines over some classes; the class with most wins, then the largest margin, has it."""

    def __init__(self, x: Sample, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.machines = {}
        for a, b in combinations(self.classes, 2):
            rows = (labels == a) | (labels == b)
            self.machines[a, b] = Svm(x[rows], labels[rows] == a)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row and the logistic of the smallest margin by which it beat the others."""
        n, k = len(x), len(self.classes)
        wins, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for (a, b), machine in self.machines.items():
            m, i, j = machine.margin(x), self.classes.index(a), self.classes.index(b)
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.lexsort((total, wins), axis=1)[:, -1] if k > 1 else np.zeros(n, dtype=int)
        rows = np.arange(n)
        margin = least[rows, best]
        sure = np.where(np.isinf(margin), 1.0, 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))
        return np.array(self.classes, dtype=object)[best], sure


#: First code points and sizes of scripts that noise is written in.
_SCRIPTS = ((0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x621, 26), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x3042, 80), (0x4E00, 3000), (0xAC00, 3000))
_CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/="
NOISE_CHARACTERS = 4000


def noises(text: str) -> list[str]:
    """Texts that look like ``text`` but hold no language; the same for the same text."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    at = int(rng.integers(0, max(1, len(text) - NOISE_CHARACTERS + 1)))
    part = text[at : at + NOISE_CHARACTERS]
    spots = [k for k, c in enumerate(part) if c.isalpha()]
    letters = [part[k] for k in spots]

    def written(new: list[str]) -> str:
        out = list(part)
        for k, c in zip(spots, new, strict=True):
            out[k] = c
        return "".join(out)

    low, size = _SCRIPTS[int(rng.integers(0, len(_SCRIPTS)))]
    plain = written([chr(97 + int(c)) for c in rng.integers(0, 26, len(spots))])
    mixed = written([letters[int(k)] for k in rng.permutation(len(letters))])
    strange = written([chr(low + int(c)) for c in rng.integers(0, size, len(spots))])
    codes = " ".join("".join(_CODES[int(c)] for c in rng.integers(0, int(rng.choice([16, len(_CODES)])), int(rng.integers(8, 60)))) for _ in range(max(1, len(part) // 40)))
    return [plain, mixed, strange, codes]


def pieces(text: str) -> list[str]:
    """One, three and twelve words in a row of a text."""
    rng, words = np.random.default_rng(zlib.crc32(text.encode()) ^ 1), text.split()
    out = []
    for n in (1, 1, 3, 12):
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return out


class Rejector:
    """Per language a machine against noise, and for every length the margin below which a text is no language."""

    def __init__(self, x: Sample, langs: np.ndarray, letters: np.ndarray, clean: np.ndarray, noise: np.ndarray):
        """``clean`` and ``noise`` tell which rows are which."""
        self.machines, self.floors = {}, {}
        against = np.flatnonzero(noise)
        for lang in sorted(set(langs[clean])):
            own = np.flatnonzero(clean & (langs == lang))
            machine = Svm(x[np.concatenate([own, against])], np.arange(len(own) + len(against)) < len(own))
            margin, long = machine.margin(x[own]), letters[own]
            floors = [self._floor(m) if len(m := margin[(long >= 2**k) & (long < 2 ** (k + 3))]) >= 20 else -np.inf for k in range(40)]
            # A longer text never has a lower floor.
            self.machines[lang] = machine
            self.floors[lang] = np.minimum(np.maximum.accumulate(floors), HIGHEST_FLOOR)

    @staticmethod
    def _floor(margins: np.ndarray) -> float:
        middle, low = np.quantile(margins, [0.5, 0.16])
        return middle - SPREADS * (middle - low)

    def noisy(self, x: np.ndarray, langs: np.ndarray, letters: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for lang, machine in self.machines.items():
            rows = np.flatnonzero(langs == lang)
            if len(rows):
                size = np.log2(np.maximum(1, letters[rows])).astype(int)
                out[rows] = machine.margin(x[rows]) < self.floors[lang][np.minimum(size, 39)]
        return out


def letter_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letter bytes of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(_LETTER[raw])])[at])


class LanguageModel:
    rejector: Rejector | None = None

    def __init__(self, x: Sample, langs: np.ndarray):
        families = np.array([family_of(v) for v in langs], dtype=object)
        self.families = Vote(x, families) if len(langs) else None
        self.within = {f: Vote(x.only(families == f), langs[families == f]) for f in sorted(set(families))}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if self.families is None or not len(x):
            return out, score
        family, sure = self.families.decide(x)
        for f, vote in self.within.items():
            rows = np.flatnonzero(family == f)
            if len(rows):
                out[rows], own = vote.decide(x[rows])
                score[rows] = np.minimum(sure[rows], own)
        return out, score


def held_out() -> Column:
    """Documents that learning never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of texts (turn, tie, lang, text, extra), and of the noise and pieces made of the extra ones."""
    for batch in batches:
        turns, ties, langs, kinds, letters, places, values = [], [], [], [], [], [], []
        for turn, tie, lang, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            made = [(WHOLE, text)]
            if extra:
                made += [(PIECE, t) for t in pieces(text)] + [(NOISE, t) for t in noises(text)]
            for kind, part in made:
                raw = np.frombuffer(part.encode(), dtype=np.uint8)
                at = np.array([0, len(raw)])
                x = features(raw, at)[0]
                spots = np.flatnonzero(x)
                turns.append(turn)
                ties.append(tie)
                langs.append(lang)
                kinds.append(kind)
                letters.append(int(letter_counts(raw, at)[0]))
                places.append(spots.astype(np.int16).tobytes())
                values.append(x[spots].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(turns, pa.float64()), pa.array(ties, pa.int64()), pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(letters, pa.int64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["turn", "tie", "lang", "kind", "letters", "places", "vals"],
        )


WHOLE, PIECE, NOISE = 0, 1, 2
_SAMPLE = "turn double, tie long, lang string, kind int, letters long, places binary, vals binary"


def learn(rows: pa.Table, reject: bool) -> LanguageModel:
    """The model of a sample (_SAMPLE)."""
    langs, kinds = (np.array(rows.column(c).to_pylist(), dtype=kind) for c, kind in (("lang", object), ("kind", np.int32)))
    letters = np.array(rows.column("letters").to_pylist(), dtype=np.int64)
    x = Sample(*([np.frombuffer(v.as_buffer(), kind) for v in rows.column(c)] for c, kind in (("places", np.int16), ("vals", np.float32))))
    whole = kinds == WHOLE
    model = LanguageModel(x.only(whole), langs[whole])
    if reject and (kinds == NOISE).any():
        # Whole texts of about the number of pieces, so that neither kind outweighs the other.
        clean = (kinds == PIECE) | (whole & (np.cumsum(whole) % max(1, whole.sum() // max(1, (kinds == PIECE).sum())) == 0))
        model.rejector = Rejector(x, langs, letters, clean, kinds == NOISE)
    return model


def _learner(reject: bool):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            model = learn(pa.Table.from_batches(rows), reject)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return fit


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, reject: bool = False, noise_per_language: int = NOISE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``sample_per_language`` labelled documents of each language, none of them held out."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    unlearnt = LanguageModel(Sample([], []), np.zeros(0, dtype=object))
    if not counts:
        return unlearnt
    # A hash bound for each language keeps about nine tenths of the allowed number; the limit guards the rest.
    shares = lambda most: F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 0.9 * most / n) if n > most else 1.0))])[F.col("lang")]
    drawn_by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    spot = F.pmod(drawn_by, F.lit(1 << 30)) / F.lit(float(1 << 30))
    extra = spot < shares(noise_per_language) if reject else F.lit(False)
    chosen = usable.where((spot < shares(sample_per_language)) & F.col("text").rlike(r"\p{L}"))
    # The limit would cut all languages alike: turns are relative to a language's share, ties go by the text's hash.
    chosen = chosen.select((spot / shares(sample_per_language)).alias("turn"), F.xxhash64("lang", "text").alias("tie"), "lang", "text", extra.alias("extra"))
    most = len(counts) * (sample_per_language + (8 * noise_per_language if reject else 0))
    rows = chosen.mapInArrow(_sampled, _SAMPLE)
    learnt = rows.orderBy(*rows.columns).limit(most).mapInArrow(_learner(reject), "model binary").collect()
    return pickle.loads(learnt[0]["model"]) if learnt else unlearnt


def _predictor(shared, reject: bool = False):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                raw, at = tokens.text_bytes(batch.column(batch.schema.get_field_index("text")))
                known = np.array([has_letter(raw[at[i] : at[i + 1]]) for i in range(batch.num_rows)], dtype=bool)
                langs, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
                for a, b in _groups(at):
                    x = features(raw, at[a : b + 1])
                    got, sure = model.predict(x)
                    if reject and model.rejector is not None:
                        got[model.rejector.noisy(x, got, letter_counts(raw, at)[a:b])] = UNKNOWN
                    langs[a:b], scores[a:b] = np.where(known[a:b], got, UNKNOWN), np.where(known[a:b], sure, 0.0)
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows that hold no language: those without letters and those that the model rejects as noise."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(shared, reject=True)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], names=["text"])
            for at, found in _numbered(predict(iter([texts]))):
                known = [lang != UNKNOWN for lang in found.column(0).to_pylist()]
                yield batch.slice(at, found.num_rows).filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    at = 0
    for batch in batches:
        yield at, batch
        at += batch.num_rows
