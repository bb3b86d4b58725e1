"""A stored inverted index of documents: built, extended, deleted from and compacted; searches read their words' buckets.

Postings (token, doc_id, tf, len) are stored by buckets of the token. Each append is a version of its own. The table
of documents says which version a document was last written or deleted in; a posting of an earlier version than
that is hidden. So an append or a deletion writes only itself, and a search looks up the documents changed since the
oldest version it reads. ``compact`` writes what is visible as one version. Totals (documents, tokens, postings) are
kept in the commit, so statistics need no scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import retrieval
from loomgraph.operators.traverse import few
from loomgraph.plans.buckets import BucketStore, Layout
from loomgraph.plans.tables import plain_tokens

#: The token under which each document's own counts are kept until its row is written: no tokenizer gives it.
SELF = ""


def term_counts(docs: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(token, doc_id, tf, len) of documents (doc_id, text), and a row with the token ``SELF`` a document whose tf is
    its number of distinct tokens. Batches of token lists are counted as numbers of their words."""
    import numpy as np
    import pyarrow as pa

    listed = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.array_remove(tokens(F.coalesce(F.col("text"), F.lit(""))), SELF), F.array().cast("array<string>")).alias("a"))

    def count(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("a")
            n = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().dictionary_encode()
            of = np.repeat(np.arange(len(n)), n)
            size = max(len(words.dictionary), 1)
            key, tf = np.unique(of * size + words.indices.to_numpy(), return_counts=True)
            doc, word = key // size, key % size
            uniq = np.bincount(doc, minlength=len(n))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array([SELF] * len(n), pa.string()), words.dictionary.take(pa.array(word))]),
                pa.concat_arrays([ids, ids.take(pa.array(doc))]),
                pa.array(np.r_[uniq, tf].astype(np.int32)), pa.array(np.r_[n, n[doc]].astype(np.int32))], names=["token", "doc_id", "tf", "len"])
    return listed.mapInArrow(count, f"token string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tf int, len int")


class TextIndex:
    """``tokens`` makes an array of tokens of a text; an index must be opened with the one it was built with."""

    def __init__(self, spark: SparkSession, root: str, tokens: Callable[[Column], Column] = plain_tokens, buckets: int = 64, id_type: str = "long"):
        self.tokens, self.spark = tokens, spark
        self.store = BucketStore(spark, root, {
            "postings": Layout(f"token string, doc_id {id_type}, tf int, len int", "token", ("token", "doc_id"), buckets),
            "docs": Layout(f"doc_id {id_type}, len int, uniq int, gone boolean", "doc_id", ("doc_id",), buckets),
        })

    @classmethod
    def load_or_build(cls, spark: SparkSession, root: str, docs: DataFrame, state: str, **how) -> TextIndex:
        """The stored index if it was built of the same ``state`` (a fingerprint of the documents), else a new one of ``docs``."""
        index = cls(spark, root, **how)
        if index.store.now.notes.get("state") != state:
            index._change(docs, None, fresh=True, state=state)
        return index

    @property
    def totals(self) -> dict[str, int]:
        """docs, tokens and postings of all visible documents."""
        return {k: self.store.now.notes.get(k, 0) for k in ("docs", "tokens", "postings")}

    def append(self, docs: DataFrame) -> None:
        """Index documents (doc_id, text); one whose id is known takes its place. Ids must be unique among them (refused
        otherwise, nothing is changed); null ids are left out, null texts are empty."""
        self._change(docs, None)

    def delete(self, ids: DataFrame) -> None:
        """Hide the documents of ``ids`` (doc_id); ids that are not there don't matter."""
        self._change(None, ids)

    def _change(self, docs: DataFrame | None, ids: DataFrame | None, fresh: bool = False, state: str | None = None) -> None:
        added, store = {}, self.store
        if docs is not None:
            added["postings"] = store.write("postings", term_counts(docs, self.tokens))
            version, buckets = added["postings"]
            mine = store.buckets("postings", [SELF])[0]
            # A document's own counts are read back from their bucket: texts are scanned once.
            own = f"{store.root}/postings/version={version}"
            rows = self.spark.read.option("basePath", own).parquet(f"{own}/bucket={mine}").where(F.col("token") == SELF) if mine in buckets else self.spark.createDataFrame([], store.layouts["postings"].schema)
            rows = rows.select("doc_id", "len", F.col("tf").alias("uniq"), F.lit(False).alias("gone"))
        else:
            rows = ids.where("doc_id is not null").select("doc_id").distinct().select("doc_id", F.lit(0).alias("len"), F.lit(0).alias("uniq"), F.lit(True).alias("gone"))
        added["docs"] = store.write("docs", rows)
        path = f"{store.root}/docs/version={added['docs'][0]}"
        new = self.spark.read.schema(f"{store.layouts['docs'].schema}, bucket int").parquet(path) if added["docs"][1] else self.spark.createDataFrame([], store.layouts["docs"].schema)
        sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(F.col("gone"), 0).otherwise(1), F.col("len").cast("long"), F.col("uniq").cast("long"))]
        n, *after = new.agg(F.count(F.lit(1)), *sums).first()
        if docs is not None and n != new.agg(F.countDistinct("doc_id")).first()[0]:
            raise ValueError("documents of one append must have different ids")
        before = [0, 0, 0]
        if store.versions("docs") and not fresh:
            known = self._current(added["docs"][1]).join(new.select("doc_id"), "doc_id", "left_semi")
            before = list(known.agg(*sums).first())
        was = [0, 0, 0] if fresh else [self.totals[k] for k in ("docs", "tokens", "postings")]
        notes = dict(zip(("docs", "tokens", "postings"), (int(w - b + a) for w, b, a in zip(was, before, after))))
        notes["state"] = state
        store.commit(added, {"postings": None, "docs": None} if fresh else None, notes)

    def _current(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, len, uniq, gone): each document as last written."""
        rows = self.store.read("docs", buckets)
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("len", "uniq", "gone"), "version").alias("d"))
        return last.select("doc_id", "d.*")

    def documents(self) -> DataFrame:
        """(doc_id, len, uniq) of all visible documents."""
        return self._current().where("not gone").drop("gone")

    def _visible(self, rows: DataFrame, versions: list[str]) -> DataFrame:
        if not versions:
            return rows
        # Numbers order versions; those of one commit differ in their tails.
        oldest = versions[0][:8]
        if self.store.versions("docs")[-1][:8] <= oldest:
            return rows
        later = self.store.read("docs", after=f"{oldest}~")
        changed, _ = few(later.groupBy("doc_id").agg(F.max(F.substring("version", 1, 8)).alias("last")))
        kept = rows.join(changed.withColumnRenamed("doc_id", "changed"), (F.col("doc_id") == F.col("changed")) & (F.substring("version", 1, 8) < F.col("last")), "left_anti")
        return kept

    def postings(self, words: list[str]) -> DataFrame:
        """(token, doc_id, tf, len) of the words; only their buckets are opened."""
        words = [w for w in dict.fromkeys(words) if w != SELF]
        rows = self.store.read("postings", self.store.buckets("postings", words)).where(F.col("token").isin(words))
        return self._visible(rows, self.store.versions("postings")).select("token", "doc_id", "tf", "len")

    def all_postings(self) -> DataFrame:
        """(token, doc_id, tf, len) of all visible documents."""
        rows = self.store.read("postings").where(F.col("token") != SELF)
        return self._visible(rows, self.store.versions("postings")).select("token", "doc_id", "tf", "len")

    def bm25(self, words: list[str], coverage: bool = False) -> DataFrame:
        """(doc_id, score, matched) from the words' buckets and the commit's totals alone."""
        t = self.totals
        one = lambda x, name: self.spark.createDataFrame([(float(x),)], f"{name} double")
        return retrieval.bm25(self.postings(words), one(t["postings"], "n"), one(t["tokens"] / t["docs"] if t["docs"] else 0.0, "avg_len"), coverage)

    def compact(self) -> None:
        """Write what is visible as one version; earlier commits stay readable until the store is vacuumed."""
        store = self.store
        rows = store.read("postings")
        postings = self._visible(rows, store.versions("postings")).select("token", "doc_id", "tf", "len")
        docs = self.documents().withColumn("gone", F.lit(False))
        added = {"postings": store.write("postings", postings), "docs": store.write("docs", docs)}
        store.commit(added, {"postings": None, "docs": None})
