"""Operator 4: language identification with a string kernel.

The kernel of two texts counts the 1- to 3-grams of characters present in both (blended spectrum,
presence), divided by the root of what each has. Kernel ridge regression, one against the rest for
every language, runs on Nyström landmarks: a text is compared with ``LANDMARKS`` training texts,
and a matrix product gives the scores of a batch.

The fit takes a bounded sample of labelled rows, about ``FIT_PER_LANG`` per language and
``MOST_FIT`` in all, chosen by a hash of doc_id; only the n-grams of the sample reach the driver.
Characters are folded to 64 classes (a-z, other letters by hash, everything else alike). Every
document is read whole and scored.

Defined results: null text and text without a letter are ``und`` with score 0, as is every text if
there is no labelled row; repeated rows are scored each; an empty table gives no rows; a row with a
null doc_id is never learned from and not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import small_side
from .registry import query, table
from .words import PIECE_BYTES, lean, text_apart, text_bytes, texts_of

FIT_PER_LANG, MOST_FIT = 400, 4000
LANDMARKS = 256
#: Rows that a task sends back at once, with their texts.
SENT_ROWS = 1000
RIDGE = 1e-2
#: Share of the sampled texts that must hold an n-gram for it to count.
LEAST_SHARE = 0.01
#: Languages scored below this are rejected by ``keep_identified``.
LEAST_SCORE = 0.4

CLASSES = 64
N_CODES = CLASSES + CLASSES**2 + CLASSES**3


def _class(code_point: int) -> int:
    letter = chr(code_point).lower()[:1]
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 + (ord(letter) * 2654435761 >> 7) % 37 if letter.isalpha() else 0


_CLASS = np.array([_class(c) for c in range(0x10000)], np.uint8)


def _classes(text: bytes) -> np.ndarray:
    """Class of each character; 0 for all but letters."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    classes = _CLASS[np.minimum(points, 0xFFFF)]
    for far in np.unique(points[points > 0xFFFF]).tolist():
        classes[points == far] = _class(far)
    return classes


def ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of consecutive texts: first, count, text of each n-gram, its code, and which texts have a letter."""
    offsets, data = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        part = data[offsets[first]:offsets[last]]
        starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[first:last + 1] - offsets[first]]
        classes = _classes(part.tobytes())
        doc = np.repeat(np.arange(last - first), np.diff(starts))
        letters = np.zeros(last - first, bool)
        letters[doc[classes > 0]] = True
        one = classes.astype(np.int32)
        two = one[:-1] * CLASSES + one[1:]
        three = two[:-1] * CLASSES + one[2:]
        same_two, same_three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
        yield (
            first, last - first, np.concatenate([doc, doc[:-1][same_two], doc[:-2][same_three]]),
            np.concatenate([one, two[same_two] + CLASSES, three[same_three] + CLASSES + CLASSES**2]), letters,
        )
        first = last


class KernelRidge:
    """One-against-the-rest kernel ridge regression on landmark texts."""

    def __init__(self, langs: list[str], codes: list[np.ndarray]):
        self.langs = sorted(set(langs))
        self.feature = np.full(N_CODES, -1, np.int32)
        if not langs:
            return
        counts = np.bincount(np.concatenate(codes), minlength=N_CODES)
        kept = np.flatnonzero(counts >= max(2, LEAST_SHARE * len(codes))) if len(codes) > 2 else np.flatnonzero(counts)
        self.feature[kept] = np.arange(len(kept))
        present = np.zeros((len(codes), len(kept)), np.float32)
        for i, own in enumerate(codes):
            at = self.feature[own]
            present[i, at[at >= 0]] = 1
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        rank = np.array([langs[:i].count(x) for i, x in enumerate(langs)])
        marks = np.sort(np.argsort(rank, kind="stable")[:LANDMARKS])
        self.landmarks = self._scaled(present[marks])
        kernel = (self._scaled(present) @ self.landmarks.T).astype(float)
        values, vectors = np.linalg.eigh(kernel[marks])
        good = values > 1e-6 * max(values.max(), 1e-9)
        root = vectors[:, good] / np.sqrt(values[good])
        mapped = np.column_stack([kernel @ root, np.ones(len(kernel))])
        weight = len(langs) / (len(self.langs) * np.array([langs.count(x) for x in langs], float))
        gram = mapped.T @ (mapped * weight[:, None]) + RIDGE * np.eye(mapped.shape[1])
        solved = np.linalg.solve(gram, mapped.T @ (y * weight[:, None]))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1]

    @staticmethod
    def _scaled(present: np.ndarray) -> np.ndarray:
        return present / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))

    def predict(self, n: int, doc: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language of each text, and its score from 0 to 1."""
        present = np.zeros((n, self.landmarks.shape[1]), np.float32)
        at = self.feature[codes]
        known = at >= 0
        present[doc[known], at[known]] = 1
        values = self._scaled(present) @ self.landmarks.T @ self.weights + self.bias
        best = values.argmax(1)
        return best, np.clip((values[np.arange(n), best] + 1) / 2, 0, 1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame) -> KernelRidge:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = labelled.groupBy("lang").count()
    n_langs = counts.count()
    each = max(1, min(FIT_PER_LANG, MOST_FIT // max(n_langs, 1)))
    shares = counts.select("lang", (F.lit(1_000_000.0) * each / F.col("count")).alias("_share"))
    # A language has at least one row in the sample if it has `each` rows or fewer.
    chosen = labelled.join(small_side(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, doc, codes, _ in ngrams(batch.column(2)):
                pairs = np.unique(doc.astype(np.int64) * N_CODES + codes)
                cuts = np.searchsorted(pairs, np.arange(n + 1) * N_CODES).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs % N_CODES).astype(np.int32)))],
                    ["lang", "doc_id", "codes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("lang", "doc_id", "text").mapInArrow(lean(present), f"lang string, doc_id {kind}, codes array<int>").toArrow()
    order = sorted(range(len(rows)), key=lambda i: (str(rows["doc_id"][i].as_py()), rows["lang"][i].as_py(), len(rows["codes"][i])))
    return KernelRidge([rows["lang"][i].as_py() for i in order], [rows["codes"][i].values.to_numpy() for i in order])


def identify_languages(docs: DataFrame, model: KernelRidge, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (doc_id), lang_pred and score of every document.

    Without a column ``text`` the last of ``carry`` holds whole rows with a field of that name.
    """
    carry = ["doc_id"] if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            for first, n, doc, codes, letters in ngrams(texts_of(batch, batch.num_columns - 1)) if shared.value.langs else ():
                best, score = shared.value.predict(n, doc, codes)
                langs[first:first + n] = np.where(letters, np.array(shared.value.langs, object)[best], "und")
                scores[first:first + n] = np.where(letters, score, 0)
            columns = [*batch.columns[:len(carry)], pa.array(langs, pa.string()), pa.array(scores)]
            found = pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:len(carry)], "lang_pred", "score"])
            yield from (found.slice(at, SENT_ROWS) for at in range(0, len(found), SENT_ROWS))

    kept = docs.select(*carry, *([F.col("text").alias("_text")] if text_apart(docs.columns) else []))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry)
    return kept.mapInArrow(lean(predict), f"{kinds}, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is found with a score of at least ``LEAST_SCORE``."""
    rows = docs.select(F.struct("*").alias("_row"))
    found = identify_languages(rows, fit_languages(docs), ["_row"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
