"""Subject areas of documents from latent Dirichlet topics.

1. Every document becomes its set of words: runs of letters of any script, so that names in code such
   as ``filing_fee`` or ``filingFee`` count as their words; scripts that leave no room between words
   (Chinese, Japanese, Thai and the like) count by pairs of characters.
2. The vocabulary is what the corpus uses neither rarely nor everywhere, judged over all documents and
   over those of each language.
3. A latent Dirichlet topic model is fitted by expectation maximisation: each pass infers the topics of
   every document where it lies, sums the expected counts over the cluster and sets the topics anew.
   Every pass covers every document once, at any size. No label takes part.
4. Each topic's top terms are inspected: how often labelled documents of each subject use them. If one
   subject holds most of that, the topic is its own; other topics are background.
5. A document is about a subject if the subject's topics hold a large enough share of its words and
   enough words in number: a passing mention stays below.

The vocabulary has at most (mean words of a document / LEAST_SHARE) entries whatever the size of the
corpus, so it, the topics and the labelled uses of words are small tables; documents and counts stay on
the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmsway.session import checkpointed

#: Scripts written without room between words, and the first code point of them.
UNSPACED, FIRST_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}", 0x0E00
#: A word has two letters or more; a capital may lead it or make up all of it, where its script has capitals. Embedded
#: data is skipped. The ranges only spare most characters the search for their kind.
WORD = (
    r"[A-Za-z0-9+/]{48,}|([a-z]{2,}+(?![\u00AA-\x{1FFFF}&&[\p{Ll}\p{M}]])|\p{Lu}?[\p{Ll}\p{M}]{2,}|\p{Lu}{2,}"
    r"|[\u0588-\x{3FFFF}&&[\p{L}\p{M}]&&[^\p{Lu}\p{Ll}]]{2,})"
)
#: The same for texts of ASCII alone, which is much faster.
ASCII_WORD = r"[A-Za-z0-9+/]{48,}|([A-Z]?[a-z]{2,}|[A-Z]{2,})"
#: Shares of documents between which a word belongs to the vocabulary.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0015, 0.15, 5
#: Documents without the word that each language is taken to have besides its own.
SPARE = 20
#: Labelled rows used at most (those with the smallest hash of their document).
MOST_LABELS = 50_000
TOPICS, ALPHA, ETA = 150, 0.02, 0.02
#: Passes over all documents, rounds for a document's own topics in a pass and when it is decided.
PASSES, ROUNDS, LAST_ROUNDS = 10, 4, 12
#: Top terms of a topic, and the share of their labelled uses that one subject must hold.
TOP_TERMS, AGREED = 20, 0.5
#: What makes a subject: share of the document's words and number of words.
SHARE, WORDS = 0.06, 2.5
#: Documents inferred at once, and words of a table of these, so that its numbers stay in the processor's cache; words of
#: a slice of counts; groups in which the parts' counts are first summed.
AT_ONCE, CELLS, SLICE, FAN = 512, 1024, 512, 32


def words_of(text: Column) -> Column:
    """The distinct lower-case words of a text; of a notebook in JSON, those of its cells as written."""
    cells = F.from_json(text, "cells array<struct<source string, text string>>")["cells"]
    written = F.concat_ws(" ", F.transform(cells, lambda c: F.concat_ws(" ", c["source"], c["text"])))
    plain = F.coalesce(F.when(F.ltrim(text).startswith("{"), F.nullif(written, F.lit(""))), text)
    every = lambda p, pattern: F.regexp_extract_all(p, F.lit(pattern), F.lit(1))
    # an array of one, so that the text is parsed once for both cases
    runs = F.transform(F.array(plain), lambda p: F.when(F.length(p) == F.octet_length(p), every(p, ASCII_WORD)).otherwise(every(p, WORD)))[0]
    found = F.array_distinct(F.transform(runs, F.lower))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))
    unspaced = lambda w: (F.ascii(w) >= FIRST_UNSPACED) & w.rlike(f"^[{UNSPACED}]")
    return F.array_remove(F.array_distinct(F.flatten(F.transform(found, lambda w: F.when(unspaced(w), pairs(w)).otherwise(F.array(w))))), "")


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject) of a bounded sample of labels, spelled as in ``areas``; unknown subjects are left out."""
    named = areas.select("subject", F.lower(F.trim("subject")).alias("_key")).distinct()
    known = labels.select("doc_id", F.lower(F.trim("subject")).alias("_key")).join(named, "_key").select("doc_id", "subject").distinct()
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(MOST_LABELS)


def vocabulary(bags: DataFrame) -> tuple[list[str], np.ndarray]:
    """Words, in order, and their numbers of documents; ``bags`` has ``words`` and ``language``."""
    sizes = bags.groupBy("language").agg(F.count(F.lit(1)).alias("of"))
    count = sizes.agg(F.sum("of")).first()[0] or 0
    used = bags.select("language", F.explode("words").alias("word")).groupBy("word", "language").agg(F.count(F.lit(1)).alias("n"))
    seen = used.join(sizes, "language").groupBy("word").agg(F.sum("n").alias("docs"), F.max(F.col("n") / (F.col("of") + SPARE)).alias("most"))
    docs = F.col("docs")
    usual = seen.where((docs >= max(LEAST_SHARE * count, LEAST_DOCS)) & (docs <= MOST_SHARE * count) & (F.col("most") <= MOST_SHARE))
    rows = usual.select("word", "docs").toPandas().sort_values("word")
    return rows["word"].tolist(), rows["docs"].to_numpy(float)


def labelled_uses(coded: DataFrame, labels: DataFrame, words: int) -> tuple[list[str], np.ndarray]:
    """Subjects, and the share of each one's labelled documents (columns) that use each word (rows)."""
    found = labels.join(coded, "doc_id").select("subject", F.explode("ids").alias("word")).groupBy("word", "subject").agg(F.count(F.lit(1)).alias("n")).toPandas()
    of = {r["subject"]: r["n"] for r in labels.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    subjects = sorted(of)
    uses = np.zeros((words, len(subjects)))
    uses[found["word"].to_numpy(int), found["subject"].map({s: i for i, s in enumerate(subjects)}).to_numpy(int)] = found["n"].to_numpy(float)
    return subjects, uses / np.array([of[s] for s in subjects], float)


def subject_topics(topics: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """The subject's column of each topic (rows of ``topics``), or -1 for background, by its top terms."""
    owner = np.full(len(topics), -1)
    for t, row in enumerate(topics):
        top = np.argsort(-row, kind="stable")[:TOP_TERMS]
        score = row[top] @ uses[top]
        if score.sum() > 0 and score.max() >= AGREED * score.sum():
            owner[t] = score.argmax()
    return owner


def infer(bags: list[np.ndarray], chance: np.ndarray, rounds: int, each: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per topic of each document; with ``each`` also the words of all, and each one's topic shares, shorter documents first.

    ``chance`` has a row for each word: its probability in each topic (float32, above 0). Documents of
    like length are laid side by side in tables of CELLS words at most (one document at least).
    """
    sizes = np.array([len(b) for b in bags], np.int64)
    out = np.zeros((len(bags), chance.shape[1]), np.float32)
    words, shares = [np.empty(0, np.int64)], [np.empty((0, chance.shape[1]), np.float32)]
    order = np.argsort(sizes, kind="stable")
    order, at = order[sizes[order] > 0], 0
    while at < order.size:
        upto = at + 1
        while upto < order.size and (upto + 1 - at) * sizes[order[upto]] <= CELLS:
            upto += 1
        docs, at = order[at:upto], upto
        used = np.arange(sizes[docs[-1]])[None, :] < sizes[docs][:, None]
        table = np.zeros(used.shape, np.int64)
        table[used] = np.concatenate([bags[d] for d in docs])
        likely = chance[table]
        likely[~used] = 0
        share = np.ones((docs.size, chance.shape[1]), np.float32)
        for _ in range(rounds):
            seen = np.matmul(likely, share[:, :, None])[:, :, 0]
            weight = np.divide(1, seen, out=np.zeros_like(seen), where=used)
            held = share * np.matmul(weight[:, None, :], likely)[:, 0, :]
            last, share = share, held + np.float32(ALPHA)
        out[docs] = held
        if each:
            words.append(table[used])
            shares.append((likely * last[:, None, :] * weight[:, :, None])[used])
    return out, np.concatenate(words), np.concatenate(shares)


def _summed(parts: DataFrame) -> DataFrame:
    """(slice, data): the sum of all partial counts of each slice, first of every FAN-th part, then of these."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(zlib.decompress(x), np.float32) for x in pdf["data"])
        return pdf.iloc[:1].assign(data=[zlib.compress(whole.tobytes(), 1)])

    some = parts.withColumn("part", F.pmod("part", F.lit(FAN))).groupBy("slice", "part").applyInPandas(add, "slice int, part int, data binary")
    return some.groupBy("slice").applyInPandas(add, "slice int, part int, data binary")


def fit_topics(coded: DataFrame, docs: np.ndarray, seed: int) -> np.ndarray:
    """Distributions over the vocabulary, one row per topic, fitted in PASSES over all documents.

    ``coded`` has ``ids``, the vocabulary words of each document; ``docs`` how many documents use each word.
    """
    sc, size = coded.sparkSession.sparkContext, len(docs)
    topics = np.random.default_rng(seed).gamma(1.0, 1.0, (TOPICS, size)) * docs
    for _ in range(PASSES):
        topics /= topics.sum(axis=1, keepdims=True)
        shared = sc.broadcast(np.ascontiguousarray(topics.T, np.float32) + np.float32(1e-12))

        def gather(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            chance, part = shared.value, 0
            total = np.zeros(chance.shape, np.float64)
            for pdf in frames:
                part = int(pdf["part"].iloc[0]) if len(pdf) else part
                for at in range(0, len(pdf), AT_ONCE):
                    _, words, held = infer(pdf["ids"].iloc[at : at + AT_ONCE].tolist(), chance, ROUNDS)
                    order = np.argsort(words, kind="stable")
                    words = words[order]
                    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]][: words.size])
                    if first.size:
                        total[words[first]] += np.add.reduceat(held[order], first, axis=0)
            cut = range(0, size, SLICE)
            yield pd.DataFrame({"slice": range(len(cut)), "part": part, "data": [zlib.compress(total[a : a + SLICE].astype(np.float32).tobytes(), 1) for a in cut]})

        parts = coded.select("ids", F.spark_partition_id().alias("part")).mapInPandas(gather, "slice int, part int, data binary")
        rows = sorted(_summed(parts).select("slice", "data").collect())
        counts = np.concatenate([np.frombuffer(zlib.decompress(r["data"]), np.float32) for r in rows])
        topics = counts.reshape(size, TOPICS).T.astype(float) + ETA
        shared.unpersist()
    return topics / topics.sum(axis=1, keepdims=True)


def encoded(bags: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, ids): the places in ``words`` of each document's words."""
    shared = bags.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [[i for w in b if (i := place.get(w)) is not None] for b in pdf["words"]]})

    return bags.select("doc_id", "words").mapInPandas(run, f"doc_id {dict(bags.dtypes)['doc_id']}, ids array<int>")


def subjects_of(docs: DataFrame, areas: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, subject) for each subject area that a document is about; often one, at times two or none.

    Null, empty and blank texts have none. Repeated rows of a document count once. The language is the
    first two letters of ``lang``, if there is such a column; null or wrong ones only make its groups
    less pure. Without labels or without any usual word the result is empty.
    """
    kind = dict(docs.dtypes)["doc_id"]
    language = F.coalesce(F.lower(F.left(F.ltrim("lang"), F.lit(2))), F.lit("")) if "lang" in docs.columns else F.lit("")
    read = docs.where(F.col("text").isNotNull()).select("doc_id", language.alias("language"), words_of(F.col("text")).alias("words"))
    bags = checkpointed(read)
    words, uses = vocabulary(bags)
    names = clean_labels(labels, areas)
    if not words or names.isEmpty():
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, subject string")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = checkpointed(encoded(bags, words).repartition(spread, "doc_id"))  # so that long files make no long tasks
    topics = fit_topics(coded, uses, seed)
    subjects, labelled = labelled_uses(coded, names, len(words))
    owner = subject_topics(topics, labelled)
    belongs = (owner[:, None] == np.arange(len(subjects))[None, :]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(topics.T, np.float32) + np.float32(1e-12), belongs))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance, belongs = shared.value
        for pdf in frames:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE]
                held = infer(part["ids"].tolist(), chance, LAST_ROUNDS, each=False)[0] @ belongs
                size = np.maximum(part["ids"].map(len).to_numpy(), 1)[:, None]
                row, subject = np.nonzero((held >= WORDS) & (held / size >= SHARE))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "subject": np.array(subjects, object)[subject]})

    return coded.mapInPandas(decide, f"doc_id {kind}, subject string").distinct()
