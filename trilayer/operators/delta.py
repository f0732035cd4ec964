"""Memory kept up to date by signed deltas: documents come and go, the layers follow.

Every table is a log of rows with a sign, a folder a batch; its current rows are
those whose signs sum to more than zero.  A batch works out which chunks start
or cease to be held by any document, takes the triples of those and recomputes
only the facts, schemas and edges they touch.  It sees the batches before it and
nothing else, writes its own folders anew and ends with a commit mark, so a
batch that is repeated, or was broken off, gives the same tables once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilayer.functions.canonical import canonical
from trilayer.functions.session import materialise
from trilayer.functions.text import hash_id
from trilayer.operators import graph, memory, ontology

_SPELLED = "head string, relation string, tail string"
_KEYS = "head_key string, rel_key string, tail_key string"
_TYPED = "head_type string, tail_type string, head_type_key string, tail_type_key string"
TABLES = {
    "members": "doc_id string, chunk_id string",
    "chunks": "chunk_id string, content string",
    "triples": f"fact_id string, given_schema string, chunk_id string, pos int, {_SPELLED}, {_KEYS}, {_TYPED}",
    "facts": f"fact_id string, {_SPELLED}, {_KEYS}, frequency long, schema_id string",
    "schemas": "schema_id string, head_type string, relation string, tail_type string, head_type_key string, rel_key string, tail_type_key string, frequency long, mentions long, chunk_id string, pos int",
    "edges": "src string, dst string, type string, weight double, relations array<string>",
    "typed": "src string, dst string, facts long",
    "vectors": "id string, embedding array<double>",
}
#: A batch's documents to (chunk_id, pos, head, relation, tail, head_type, tail_type), and texts (id, text) to (id, embedding).
Extract = Callable[[DataFrame], DataFrame]


def resolve(keyed: DataFrame, resolutions: DataFrame | None) -> DataFrame:
    """Keyed triples with resolutions (fact_id, action, head, relation, tail) replayed: modified ones say what they were changed to, discarded ones go."""
    t = keyed.withColumn("fact_id", memory.fact_id())
    if resolutions is not None:
        r = resolutions.where("action in ('modified', 'discarded')").dropDuplicates(["fact_id"])
        r = canonical(r, {"head": "_hk", "relation": "_rk", "tail": "_tk"}).select("fact_id", "action", *[F.col(c).alias(f"_{c}") for c in ("head", "relation", "tail")], "_hk", "_rk", "_tk")
        t = t.join(r, "fact_id", "left").where(~F.col("action").eqNullSafe("discarded"))
        new = F.col("action").isNotNull()
        for c, n in (("head", "_head"), ("relation", "_relation"), ("tail", "_tail"), ("head_key", "_hk"), ("rel_key", "_rk"), ("tail_key", "_tk")):
            t = t.withColumn(c, F.when(new, F.col(n)).otherwise(F.col(c)))
        t = t.withColumn("fact_id", memory.fact_id())
    cols = [c.strip().split()[0] for c in TABLES["triples"].split(",")]
    return t.withColumn("given_schema", ontology.schema_id()).select(*cols)


def layers(triples: DataFrame, chunks: DataFrame) -> memory.Memory:
    """Typed memory of resolved triples, as a full build makes it."""
    m = memory.build(triples, chunks)
    facts = ontology.link_schemas(m.facts, triples)
    return m.with_(facts=facts, schemas=ontology.schema_frequency(ontology.dedup_schemas(triples), facts))


def _signed(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("n", F.lit(n).cast("long"))


def _summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*[c for c in signed.columns if c != "n"]).agg(F.sum("n").alias("n"))


def _live(signed: DataFrame) -> DataFrame:
    return _summed(signed).where("n > 0").drop("n")


def _diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that leave (-1) and rows that come (1)."""
    return _summed(_signed(old, -1).unionByName(_signed(new.select(old.columns), 1))).where("n <> 0")


@dataclass
class DeltaMemory:
    """The tables below ``path``, a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def _numbers(self, kind: str) -> list[int]:
        try:
            return sorted(r["number"] for r in self.spark.read.schema("number long").parquet(f"{self.path}/{kind}").distinct().collect())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _mark(self, kind: str, number: int) -> None:
        self.spark.range(number, number + 1, 1, 1).select(F.col("id").alias("number")).write.mode("overwrite").parquet(f"{self.path}/{kind}/at={number}")

    def batches(self) -> list[int]:
        return self._numbers("commits")

    def signed(self, table: str, before: int | None = None) -> DataFrame:
        """The log of a table, from its newest base on, without batches from ``before`` on."""
        fits = lambda k: before is None or k < before
        bases = [k for k in self._numbers("bases") if fits(k)]
        since = [k for k in self.batches() if fits(k) and (not bases or k > bases[-1])]
        paths = [f"{self.path}/log/{table}/batch={k}" for k in since] + [f"{self.path}/base/{table}/upto={k}" for k in bases[-1:]]
        schema = f"{TABLES[table]}, n long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, table: str, before: int | None = None) -> DataFrame:
        """Current rows of a table."""
        return _live(self.signed(table, before))

    def memory(self) -> memory.Memory:
        """The three layers as a full build of the documents that are left would give them."""
        facts = self.table("facts").withColumn("active", F.lit(True))
        passages = self.table("chunks").select(F.col("chunk_id").alias("passage_id"), "content", F.lit("text").alias("modality"))
        links = self.table("edges").where("type = 'FACT_PASSAGE'").select(F.col("src").alias("fact_id"), F.col("dst").alias("passage_id"))
        return memory.Memory(facts, passages, links, self.table("schemas").drop("mentions", "chunk_id", "pos"))

    def edges(self) -> DataFrame:
        """All edges; those between types and from entities to types get their weights here, from counts kept by the batches."""
        typed = self.signed("typed").groupBy("src", "dst").agg(F.sum(F.col("facts") * F.col("n")).alias("n")).where("n > 0")
        members = typed.groupBy("dst").agg(F.count("*").alias("m"))
        typed = typed.join(members, "dst").select("src", "dst", F.lit("ENTITY_TO_TYPE").alias("type"), (1 / F.col("m")).alias("weight"), F.lit(None).cast("array<string>").alias("relations"))
        return self.table("edges").unionByName(typed).unionByName(graph.type_relations(self.table("schemas")))

    def compact(self) -> None:
        """Write the current rows as a base, from which readers then go on."""
        done = self.batches()
        if done:
            for t in TABLES:
                rows = self.signed(t).groupBy("src", "dst").agg(F.sum(F.col("facts") * F.col("n")).alias("facts")).where("facts <> 0") if t == "typed" else self.table(t)
                _signed(rows, 1).write.mode("overwrite").parquet(f"{self.path}/base/{t}/upto={done[-1]}")
            self._mark("bases", done[-1])

    def apply(self, changes: DataFrame, extract: Extract, batch_id: int, resolutions: DataFrame | None = None, embed: Extract | None = None) -> None:
        """Take in one batch of (doc_id, chunk_id, content, removed).

        A row that isn't removed adds a chunk to its document; what is there
        already changes nothing.  A removed row (only its doc_id counts) takes
        all chunks of its document away, but for those the same batch adds.  A
        chunk lives while any document holds it; only chunks that start to live
        are extracted and embedded.  Batch ids rise; one that is repeated
        replaces what it wrote before.
        """
        out: dict[str, DataFrame] = {}
        changes = materialise(changes.select("doc_id", "chunk_id", "content", F.coalesce("removed", F.lit(False)).alias("removed")))
        added = changes.where("not removed and chunk_id is not null").select("doc_id", "chunk_id").distinct()
        held = materialise(self.table("members", batch_id).join(changes.select("doc_id").distinct(), "doc_id", "left_semi"))
        gone = held.join(changes.where("removed").select("doc_id").distinct(), "doc_id", "left_semi").join(added, ["doc_id", "chunk_id"], "left_anti")
        out["members"] = materialise(_signed(added.join(held, ["doc_id", "chunk_id"], "left_anti"), 1).unionByName(_signed(gone, -1)))

        moved = out["members"].groupBy("chunk_id").agg(F.sum("n").alias("d"))
        refs = self.table("members", batch_id).join(moved.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("refs"))
        moved = materialise(moved.join(refs, "chunk_id", "left").select("chunk_id", "d", F.coalesce("refs", F.lit(0)).alias("refs")))
        born, died = moved.where("refs = 0 and d > 0").select("chunk_id"), moved.where("refs > 0 and refs + d <= 0").select("chunk_id")
        text = changes.where("not removed").groupBy("chunk_id").agg(F.min("content").alias("content")).join(born, "chunk_id", "left_semi")
        text = materialise(text)
        out["chunks"] = _signed(text, 1).unionByName(_signed(self.table("chunks", batch_id).join(died, "chunk_id", "left_semi"), -1))

        keyed = canonical(extract(text), {"head": "head_key", "relation": "rel_key", "tail": "tail_key", "head_type": "head_type_key", "tail_type": "tail_type_key"})
        old = self.table("triples", batch_id)
        out["triples"] = materialise(_signed(resolve(keyed, resolutions).distinct(), 1).unionByName(_signed(old.join(died, "chunk_id", "left_semi"), -1)))
        out["facts"] = materialise(self._facts(out["triples"], old, batch_id))
        out["schemas"] = materialise(self._schemas(out, died, old, batch_id))
        out["edges"] = materialise(self._edges(out, batch_id))
        out["typed"] = self._typed(out, batch_id)
        out["vectors"] = self._vectors(out, embed, batch_id)
        for t, rows in out.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/log/{t}/batch={batch_id}")
        self._mark("commits", batch_id)

    def _facts(self, delta: DataFrame, old: DataFrame, batch_id: int) -> DataFrame:
        touched = delta.select("fact_id").distinct()
        live = materialise(_live(_signed(old.join(touched, "fact_id", "left_semi"), 1).unionByName(delta)))
        now = ontology.link_schemas(memory.fact_frequency(memory.dedup_facts(live), memory.fact_passage(live)), live)
        return _diff(self.table("facts", batch_id).join(touched, "fact_id", "left_semi"), now)

    def _schemas(self, out: dict[str, DataFrame], died: DataFrame, old_triples: DataFrame, batch_id: int) -> DataFrame:
        """Counts by their changes; a schema is spelled anew only where the triple that gave its spelling has gone."""
        delta = out["triples"].withColumnRenamed("given_schema", "schema_id")
        counts = delta.groupBy("schema_id").agg(F.sum("n").alias("dm"), F.lit(0).cast("long").alias("df"))
        counts = counts.unionByName(out["facts"].where("schema_id is not null").groupBy("schema_id").agg(F.lit(0).cast("long").alias("dm"), F.sum("n").alias("df")))
        counts = materialise(counts.groupBy("schema_id").agg(F.sum("dm").alias("dm"), F.sum("df").alias("df")))
        old = materialise(self.table("schemas", batch_id).join(counts, "schema_id", "left_semi"))
        spelled = ["schema_id", "chunk_id", "pos", "head_type", "relation", "tail_type", "head_type_key", "rel_key", "tail_type_key"]
        lost = old.join(died, "chunk_id", "left_semi").select("schema_id")
        again = old_triples.withColumnRenamed("given_schema", "schema_id").join(lost, "schema_id", "left_semi").join(died, "chunk_id", "left_anti")
        found = old.join(died, "chunk_id", "left_anti").select(spelled).unionByName(delta.where("n > 0").select(spelled)).unionByName(again.select(spelled))
        first = found.groupBy("schema_id").agg(F.min(F.struct(*spelled[1:])).alias("t")).select("schema_id", "t.*")
        was = old.select("schema_id", F.col("frequency").alias("_f"), F.col("mentions").alias("_m"))
        now = counts.join(was, "schema_id", "left").join(first, "schema_id")
        now = now.withColumn("frequency", F.coalesce("_f", F.lit(0)) + F.col("df")).withColumn("mentions", F.coalesce("_m", F.lit(0)) + F.col("dm")).where("mentions > 0")
        return _diff(old, now)

    def _edges(self, out: dict[str, DataFrame], batch_id: int) -> DataFrame:
        none, one = F.lit(None).cast("array<string>").alias("relations"), F.lit(1.0).alias("weight")
        made = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("type"), one, none, "n")
        t = out["triples"].select("fact_id", "chunk_id", F.explode(F.array("head_key", "tail_key")).alias("e"), "n")
        links = t.select(F.col("fact_id").alias("src"), F.col("chunk_id").alias("dst"), "n").distinct()
        ends = t.select(hash_id(F.col("e"), "entity-").alias("src"), F.col("chunk_id").alias("dst"), "n").distinct()
        typed = _summed(out["facts"].where("schema_id is not null").select(F.col("fact_id").alias("src"), F.col("schema_id").alias("dst"), "n")).where("n <> 0")

        a, b = hash_id(F.col("head_key"), "entity-"), hash_id(F.col("tail_key"), "entity-")
        pair = lambda f: f.where("head_key <> tail_key").withColumn("src", F.least(a, b)).withColumn("dst", F.greatest(a, b))
        touched = materialise(pair(out["facts"]).select("src", "dst").distinct())
        cols = [c for c in out["facts"].columns if c != "n"]
        facts = pair(self.table("facts", batch_id)).join(touched, ["src", "dst"], "left_semi").select(cols)
        facts = _live(_signed(facts, 1).unionByName(out["facts"].select(*cols, "n"))).withColumn("active", F.lit(True))
        before = self.table("edges", batch_id).where("type = 'ENTITY_RELATION'").join(touched, ["src", "dst"], "left_semi")
        between = _diff(before, graph.entity_relations(facts))
        return made(links, "FACT_PASSAGE").unionByName(made(ends, "PASSAGE_ENTITY")).unionByName(made(typed, "FACT_SCHEMA")).unionByName(between)

    def _typed(self, out: dict[str, DataFrame], batch_id: int) -> DataFrame:
        """Number of facts that give an entity a type, as changes."""
        named = self.table("schemas", batch_id).select("schema_id", "head_type_key", "tail_type_key").unionByName(out["schemas"].select("schema_id", "head_type_key", "tail_type_key")).distinct()
        f = out["facts"].join(named, "schema_id")
        end = lambda e, t: F.struct(F.col(e).alias("e"), F.col(t).alias("t"))
        ends = f.select(F.explode(F.array(end("head_key", "head_type_key"), end("tail_key", "tail_type_key"))).alias("x"), "n")
        s = ends.groupBy(hash_id(F.col("x.e"), "entity-").alias("src"), hash_id(F.col("x.t"), "type-").alias("dst")).agg(F.sum("n").alias("facts"))
        return _signed(s.where("facts <> 0"), 1)

    def _vectors(self, out: dict[str, DataFrame], embed: Extract | None, batch_id: int) -> DataFrame:
        """Chunks and facts that come are embedded, those that go lose their vector, the others keep theirs."""
        if embed is None:
            return self.spark.createDataFrame([], f"{TABLES['vectors']}, n long")
        ids = out["facts"].groupBy("fact_id").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.concat_ws("\t", "head", "relation", "tail"))).alias("text"))
        ids = ids.select(F.col("fact_id").alias("id"), "text", "n").unionByName(out["chunks"].select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), "n"))
        ids = materialise(ids.where("n <> 0"))
        new = embed(ids.where("n > 0").select("id", "text")).select("id", "embedding")
        return _signed(new, 1).unionByName(_signed(self.table("vectors", batch_id).join(ids.where("n < 0"), "id", "left_semi"), -1))


def stream_memory(changes: DataFrame, store: DeltaMemory, extract: Extract, checkpoint: str, resolutions: DataFrame | None = None):  # noqa: ANN201
    """A stream of (doc_id, chunk_id, content, removed) that keeps ``store`` up to date, once per micro-batch."""
    return changes.writeStream.foreachBatch(lambda batch, k: store.apply(batch, extract, k, resolutions)).option("checkpointLocation", checkpoint)
