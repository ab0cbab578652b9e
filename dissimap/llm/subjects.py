"""Subject areas of documents by a seeded non-negative factorisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.llm.commit_text import words
from dissimap.session import cut, drop

#: Labelled documents that seed the factors, at most; subjects, at most.
MOST_LABELLED, MOST_SUBJECTS = 10_000, 256
#: A word is in the vocabulary if at least this share of the documents (and 3) has it: this bounds the vocabulary by the
#: mean number of words of a document, divided by it.
LEAST_SHARE, LEAST_DOCUMENTS = 5e-5, 3
#: A word seeds a subject if at least so many labelled documents have it, and this share of them the subject.
SEED_DOCUMENTS, SEED_SHARE = 3, 0.7
#: Of a word's documents with any subject, the share of one that makes the word its own, and the share all own subjects, of which there are OWNERS at most, must have.
OWN_SHARE, OWNED_SHARE, OWNERS = 0.2, 0.55, 3
#: How much greater than in the whole corpus the odds of a subject must be among the documents of a word it owns.
OWN_ODDS = 2.0
#: The share of a word's documents that must have some subject for a subject to own the word.
SETTLED_SHARE = 0.3
#: Steps for a document's mixture with the words' factors held.
INNER = 6


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 1000):
            part = b.slice(s, 1000)
            found = pa.array([words(t) for t in part.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), found], ["doc_id", "words"])


def _numbers(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.string())
        import pyarrow.compute as pc

        for b in batches:
            col = b.column(1)
            at = pc.index_in(col.flatten(), value_set=terms)
            n = np.diff(np.asarray(col.offsets)) if len(col) else np.empty(0, int)
            row = np.repeat(np.arange(len(col)), n)
            ok = np.asarray(pc.is_valid(at))
            ids = np.asarray(at.fill_null(0), np.int32)[ok]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[ok], minlength=len(col)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], ["doc_id", "terms"])

    return run


@dataclass
class Factors:
    """The subjects' factors of the words that have any; all other words belong to the rest alone, whatever their number, and say nothing about a mixture's
    subjects."""

    at: np.ndarray  # each word's row in f, -1 if it belongs to the rest
    f: np.ndarray  # words x subjects

    def own(self, start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents' words, those with factors, as rows of f."""
        row = self.at[terms]
        have = row >= 0
        return np.r_[0, np.cumsum(have)][start], row[have]


def mixtures(start: np.ndarray, rows: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture of each document (a row of non-negative weights, one for each subject, that sum to its number of words with factors) and each
    word's share of each subject: multiplicative updates with the factors held. start: where each document's words begin
    in rows (of f), and their number at the end."""
    n = len(start) - 1
    doc = np.repeat(np.arange(n), np.diff(start))
    g = f[rows]
    w = np.ones((n, f.shape[1]))
    p = np.zeros_like(g)
    for _ in range(INNER):
        p = w[doc] * g
        p /= p.sum(1, keepdims=True) + 1e-300
        total = np.vstack([np.zeros(p.shape[1]), np.cumsum(p, 0)])
        w = np.maximum(total[start[1:]] - total[start[:-1]], 0) + 1e-9
    return w, p


def _batches(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for s in range(0, b.num_rows, 5000):
            part = b.slice(s, 5000)
            col = part.column(1)
            n = np.asarray(col.value_lengths().fill_null(0), np.int64) if len(col) else np.empty(0, np.int64)
            yield part.column(0), np.concatenate([[0], np.cumsum(n)]), np.asarray(col.flatten(), np.int64)


def _update(shared, least: float, grow: bool):
    """Sums for the words' factors over a partition: of all words by the documents' mixtures (grow), or of the words with factors by their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: Factors = shared.value
        k = factors.f.shape[1]
        names = np.arange(len(factors.at)) if grow else np.flatnonzero(factors.at >= 0)
        sums = np.zeros((len(factors.at) if grow else len(factors.f), k))
        for _, start, terms in _batches(batches):
            own, rows = factors.own(start, terms)
            w, p = mixtures(own, rows, factors.f)
            if grow:
                has = np.where(w >= least, w, 0)
                theta = has / np.maximum(has.sum(1, keepdims=True), 1e-12)
                some = np.repeat(theta.any(1), np.diff(start))
                p, rows = theta[np.repeat(np.arange(len(theta)), np.diff(start))[some]], terms[some]
            for s in range(k):
                sums[:, s] += np.bincount(rows, p[:, s], len(sums))
        some = np.flatnonzero(sums.sum(1) > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int32)), *(pa.array(sums[some, s]) for s in range(k))], ["term", *(f"s{s}" for s in range(k))])

    return run


def _found(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: Factors = shared.value
        for ids, start, terms in _batches(batches):
            w, _ = mixtures(*factors.own(start, terms), factors.f)
            row, s = np.nonzero(w >= least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array(w[row, s])], ["doc_id", "s", "weight"])

    return run


def _owners(shared, base: np.ndarray):
    """The words that subjects own, with their sums for these subjects; of sums (term, s0, s1, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.column_stack([np.asarray(c) for c in b.columns[1:]]) if b.num_rows else np.empty((0, b.num_columns - 1))
            sums = _owned(sums, shared.value[np.asarray(b.column(0))], base)
            some = np.flatnonzero(sums.any(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *(pa.array(sums[some, s]) for s in range(sums.shape[1]))], b.schema.names)

    return run


def _seed(labelled: list, subjects: list[str], terms: dict[str, int], df: np.ndarray) -> Factors:
    """The first factors, which hold the seeding words alone."""
    at = {s: i for i, s in enumerate(subjects)}
    c, n = np.zeros((len(df), len(subjects))), np.zeros(len(df))
    for r in labelled:
        own = sorted({at[s] for s in r.subjects if s in at})
        ids = [terms[w] for w in r.words if w in terms]
        n[ids] += 1
        for s in own:
            c[ids, s] += 1 / len(own)
    ok = (n[:, None] >= SEED_DOCUMENTS) & (c >= SEED_SHARE * np.maximum(n, 1)[:, None])
    some = np.flatnonzero(ok.any(1))
    return _factors(some, np.where(ok, df[:, None], 0.0)[some], df)


def _factors(terms: np.ndarray, sums: np.ndarray, df: np.ndarray) -> Factors:
    """Factors that sum to 1 for each subject."""
    at = np.full(len(df), -1, np.int32)
    at[terms] = np.arange(len(terms))
    return Factors(at, sums / np.maximum(sums.sum(0, keepdims=True), 1e-300))


def _owned(sums: np.ndarray, df: np.ndarray, base: np.ndarray) -> np.ndarray:
    """sums of words for the subjects that own them, 0 elsewhere. base: each subject's part of the corpus."""
    total = sums.sum(1, keepdims=True)
    share = sums / np.maximum(total, 1e-12)
    odds = OWN_ODDS * base / (1 - base)
    own = (share >= np.maximum(OWN_SHARE, odds / (1 + odds))) & (total >= np.maximum(LEAST_DOCUMENTS, SETTLED_SHARE * df[:, None]))
    ok = (np.where(own, share, 0).sum(1) >= OWNED_SHARE) & (own.sum(1) <= OWNERS)
    return np.where(own & ok[:, None], sums, 0.0)


def subject_areas(
    documents: DataFrame, subjects: DataFrame, labels: DataFrame, least_words: float = 1.5, rounds: tuple[int, int] = (2, 2)
) -> DataFrame:
    """(doc_id bigint, subject string, weight double): the areas each document deals with. weight is the document's part of
    the area's factor, in words: how many different words of the area it has, where a word that several factors share counts in parts.

    A document's words are those of its commits' messages, paths and changed lines (commit_text). The document-word
    matrix, of every document, is factored into one component for each subject and one for the rest, in alternating
    non-negative updates: documents' mixtures with the words held, then words with the mixtures held. The components are
    anchored by labels(doc_id, subject), of which MOST_LABELLED documents at most are used: at first a subject holds the
    words that mostly documents with its label have. In rounds[0] rounds each word is weighed by its documents' mixtures, and goes to
    the subjects that own it (a word spread over subjects goes to the rest: templates of any language do); rounds[1] rounds
    are multiplicative updates with those zeros kept. A wrong label moves no word by itself.

    A document has an area if its weight there is at least least_words. Null, empty and wordless texts have none.
    Without labels or subjects there are no rows. Rows that repeat a doc_id are documents of their own.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    names = sorted(r[0] for r in subjects.where("subject is not null").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    bags = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_words, "doc_id bigint, words array<string>"))
    least = max(float(LEAST_DOCUMENTS), LEAST_SHARE * bags.count())
    count = bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    vocabulary = sorted((r.word, r.n) for r in count.toLocalIterator())  # bounded by LEAST_SHARE
    marked = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = marked.join(bags, "doc_id").select("subjects", "words").limit(2 * MOST_LABELLED).collect()
    if not names or not vocabulary or not sample:
        return spark.createDataFrame([], "doc_id bigint, subject string, weight double")
    terms = {w: i for i, (w, _) in enumerate(vocabulary)}
    df = np.array([n for _, n in vocabulary], float)
    numbered = cut(bags.mapInArrow(_numbers(sc.broadcast(list(terms))), "doc_id bigint, terms array<int>"), bags)  # bounded by LEAST_SHARE
    factors = _seed(sample, names, terms, df)
    k = len(names)
    kind = "term int, " + ", ".join(f"s{s} double" for s in range(k))
    counts = sc.broadcast(df)
    for i in range(sum(rounds)):
        grow = i < rounds[0]
        got = numbered.mapInArrow(_update(sc.broadcast(factors), least_words, grow), kind)
        got = got.groupBy("term").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)])
        if grow:
            got = cut(got)
            whole = np.array(got.agg(*[F.coalesce(F.sum(f"s{s}"), F.lit(0.0)) for s in range(k)]).first(), float)
            base = np.minimum(whole / max(whole.sum(), 1e-12), 1 - 1e-9)
            found = got.mapInArrow(_owners(counts, base), kind).toArrow()  # a row for each word that a subject owns
            drop(got)
        else:
            found = got.toArrow()  # of such words again
        order = np.argsort(np.asarray(found["term"]))
        factors = _factors(np.asarray(found["term"])[order], np.column_stack([np.asarray(found[f"s{s}"])[order] for s in range(k)]), df)
    out = numbered.mapInArrow(_found(sc.broadcast(factors), least_words), "doc_id bigint, s int, weight double")
    return out.select("doc_id", F.get(F.array(*map(F.lit, names)), "s").alias("subject"), "weight")
