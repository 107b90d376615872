"""The pipeline's stages against brute force on small tables with the awkward cases."""

import os
import re
import shutil
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import common, packing, quality_classifier, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_toxic` int, `a.b` string, `_hash` string"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    rows, labels = [], []
    for i in range(400):
        t = ". ".join(prose(10) for _ in range(6)) + "."
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.4)
        if toxic:
            t = t.replace(" w", " nastyword w", 1)
        if poor:
            t = re.sub(r"(w[0-9]+)", r"\1###", t)
        rows.append((i, t))
        labels.append((i, 1 - poor, toxic))
    long = " ".join(f"u{i}" for i in range(3000))
    rows += [(500, long), (501, long + " tail"), (502, long.upper()), (503, None), (504, ""), (505, " \n"), (506, ""), (510, "one two"), (511, "One  two")]
    rows += [(520, long + " tail more"), (520, prose(60)), (521, prose(60)), (521, rows[-1][1]), (None, long), (None, long)]
    rows += [(522, prose(50)), (522, prose(50))]  # one id, two texts
    again = prose(40)
    rows += [(530, again), (530, again), (530, again + " x")]  # one id, copies and a near copy
    base = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", None, len(t or ""), 3, "d", "h") for i, t in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")


@pytest.mark.parametrize("module, stage, wanted", [(toxicity, corpus_pipeline.drop_toxic, 0), (quality_classifier, corpus_pipeline.drop_poor, 1)])
def test_filters(spark, folder, module, stage, wanted):
    """Each row by itself through the trained model, every column kept."""
    docs = docs_of(spark, folder)
    model = module.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    least = 0.5 if module is toxicity else 0.3

    def score(text):
        import pyarrow as pa

        got = model.score(*common.text_bytes(pa.array([text], pa.string())))
        return float((got[0] if isinstance(got, tuple) else got)[0])

    want = [r for r in docs.collect() if (score(r["text"]) >= least) == bool(wanted)]
    got = stage(spark, docs, folder)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(got.collect(), key=key) == sorted(want, key=key) and 100 < len(want) < docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies(spark, folder):
    docs = docs_of(spark, folder)
    rows = sorted(docs.collect(), key=key)
    distinct = sorted({(r["doc_id"], r["text"] or "", r["text"] is None) for r in rows if r["doc_id"] is not None})
    sets = [shingles(t) for _, t, _ in distinct]
    comp = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    got = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert got.schema.simpleString() == docs.schema.simpleString()
    found = sorted(got.collect(), key=key)
    assert sum(r["doc_id"] is None for r in found) == 2  # rows without an id stay
    left = [(r["doc_id"], r["text"] or "", r["text"] is None) for r in found if r["doc_id"] is not None]
    assert len(set(left)) == len(left) and set(left) <= set(distinct)
    kept = [distinct.index(x) for x in left]
    with_words = [i for i in kept if sets[i]]
    assert sorted(comp[i] for i in with_words) == sorted({comp[i] for i in range(len(distinct)) if sets[i]})  # one of each group
    for i in with_words:
        assert distinct[i][0] == min(distinct[j][0] for j in range(len(distinct)) if comp[j] == comp[i])
    assert sum(not sets[i] for i in kept) == sum(not s for s in sets)
    assert {i for i, _, _ in left if i in (500, 501, 502, 510, 511, 520, 521, 522, 530)} == {500, 510, 520, 521, 522, 530}
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), folder).count() == 0


def test_near_copies_named_in_proportion(spark, folder, monkeypatch):
    """What the stage joins to the rows to name their groups doesn't grow with the number of partitions."""
    write, plans = corpus_pipeline.materialize, []

    def told(df, name, *a, **b):
        if name == "groups":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan())
        return write(df, name, *a, **b)

    def made(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return made(plan.executedPlan())
        if name.endswith("QueryStage"):
            return made(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if name.startswith("Generate") else 0
        return own + sum(made(plan.children().apply(i)) for i in range(plan.children().size()))

    monkeypatch.setattr(corpus_pipeline, "materialize", told)
    docs, before = docs_of(spark, folder), spark.conf.get("spark.sql.shuffle.partitions")
    copies = docs.where("doc_id < 300").withColumn("doc_id", F.col("doc_id") + 1000)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert corpus_pipeline.drop_near_copies(spark, docs.where("doc_id < 400").unionAll(copies), folder).count() == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [made(p) for p in plans] == [300]


def test_run(spark, folder):
    """The whole: the pieces of what the stages keep, by the library's ids, gapless in sequences that are never too long."""
    from tokenizers import Tokenizer

    docs = docs_of(spark, folder)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, spark.createDataFrame(kept.collect(), docs.schema), folder)
    own = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    want = []
    for r in kept.collect():
        ids = np.array(own.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(-1 if r["doc_id"] is None else r["doc_id"], k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = corpus_pipeline.run(spark, folder).toPandas().fillna({"doc_id": -1})
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == sorted(want)
    r = got.sort_values(["sequence_id", "offset"])
    assert (r.groupby("sequence_id").length.cumsum() - r.length == r.offset).all()
    counts = np.bincount(got.length, minlength=1025)
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and packing.bound(counts, 1024) <= got.sequence_id.nunique() <= packing.bound(counts, 1024) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]


def test_empty_run(spark, folder, tmp_path):
    docs_of(spark, folder).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_start_no_programs_for_folders(folder, tmp_path):
    """Spark's local file system starts a chmod for each folder that it makes, beside the driver's whole memory: not for the
    tables of stage 3."""
    (tmp_path / "bin").mkdir()
    shim = tmp_path / "bin/chmod"
    shim.write_text(f'#!/bin/sh\necho "$*" >> {tmp_path}/said\nexec {shutil.which("chmod")} "$@"\n')
    shim.chmod(0o755)
    script = f"""
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
docs = spark.read.parquet("{folder}/documents.parquet")
print("rows", corpus_pipeline.drop_near_copies(spark, docs, "{folder}").count())
"""
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_ENV_LOADED"))}
    out = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert "rows 4" in out.stdout, out.stderr[-2000:]
    said = (tmp_path / "said").read_text().splitlines()
    assert any("/part-" in x for x in said)  # it does for files
    assert not [x for x in said if re.search(r"/cladeflow-[^/]+/[a-z-]+-[0-9a-f]{12}(/_temporary)?(/0)?(/_temporary)?$", x)]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_return_the_heap(spark, folder, stage):
    """What earlier steps have made of a heap isn't kept beside a stage's Python workers: each has it collected as a whole."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", b.getName())]
    whole = lambda: sum(b.getCollectionCount() for b in beans)
    before = whole()
    stage(spark, docs_of(spark, folder), folder)
    assert beans and whole() > before
