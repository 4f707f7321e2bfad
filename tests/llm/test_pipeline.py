import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "?! 12 34", "en", "s", 8), (None, "the and of with house", "en", "s", 5)], docs.schema)
    repeated = docs.limit(1)
    docs = docs.unionByName(extra).unionByName(repeated)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert 900_001 not in ids and 900_002 not in ids
        assert 0 < len(ids) <= docs.count()
        if name == "near_duplicates":
            assert len(ids) == len(set(ids))
        docs = corpus_pipeline.settle(kept, "test-stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, predicted int, row string, _key string, id bigint, h bigint"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "mine", 9, "r", "k", 7, 8) for i, t in texts], SCHEMA)


def words(tag, n=60):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_near_duplicates_decide_by_row(spark):
    """Other texts under an id stay; of copies without an id one stays; blank ones do."""
    a, b, c, d, e = (words(t) for t in "abcde")
    docs = rows_of(spark, [(3, a), (5, a), (5, b), (7, c), (7, d), (None, e), (None, e), (None, a), (8, b + " more"), (9, None), (9, " "), (3, a)])
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted([(3, a), (5, b), (7, c), (7, d), (0, e), (9, ""), (9, " ")])
    assert {(r.score, r.lang_pred, r.predicted, r["row"], r["_key"], r.id, r.h) for r in rows} == {(0.5, "mine", 9, "r", "k", 7, 8)}


def test_leaks_go_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = rows_of(spark, [(1, f"{words('x')} {item} {words('y')}"), (1, words("z")), (None, item), (None, words("q"))])
    kept = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted([words("z"), words("q")])


def test_classifying_stages_keep_clashing_columns(spark):
    docs = rows_of(spark, [(1, "the house and the garden with the tree"), (2, "12 34"), (3, None)])
    for stage in (corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert {(r.score, r.lang_pred, r.predicted) for r in kept.collect()} <= {(0.5, "mine", 9)}


def test_empty_tables(spark):
    docs = rows_of(spark, []).select(*spark.read.parquet(f"{SF}/documents.parquet").columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    per = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert per and max(r[1] for r in per) <= 2048


def test_relieve_gives_the_drivers_memory_back(spark, monkeypatch):
    """What nothing refers to is collected; the JVM's options are as before."""
    import gc

    from tidemark.llm import common

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean
    kind = jvm.java.lang.Class.forName
    diagnostic = kind("com.sun.management.HotSpotDiagnosticMXBean")
    option = lambda name: diagnostic.getMethod("getVMOption", _classes(gateway, jvm, ["java.lang.String"])).invoke(bean(diagnostic), _objects(gateway, jvm, [name])).getValue()
    ratios = option("MinHeapFreeRatio"), option("MaxHeapFreeRatio")
    held = [jvm.java.nio.ByteBuffer.allocate(1 << 18) for _ in range(1600)]
    jvm.System.gc()  # they are old now, and stay until something collects them
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    full = used()
    del held
    gc.collect()
    monkeypatch.setattr(common, "_relieved", -1e9, raising=False)
    common.relieve(spark)
    assert used() < full - (300 << 20)
    assert (option("MinHeapFreeRatio"), option("MaxHeapFreeRatio")) == ratios


def _classes(gateway, jvm, names):
    out = gateway.new_array(jvm.java.lang.Class, len(names))
    for k, x in enumerate(names):
        out[k] = jvm.java.lang.Class.forName(x)
    return out


def _objects(gateway, jvm, values):
    out = gateway.new_array(jvm.java.lang.Object, len(values))
    for k, x in enumerate(values):
        out[k] = x
    return out
