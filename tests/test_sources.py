import hashlib
import json
import tempfile
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import example, frame, random_examples, vectors
from pairforge import constants as K
from pairforge.operators import lookup, registry
from pairforge.plans import jobs
from pairforge.plans.settings import JobSettings
from pairforge.sources import catalogue as C
from pairforge.session import shared_dir
from pairforge.sources import tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="pairforge-test-")


def put(spark, folder, source, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(source.path(folder))


def test_paths_and_catalogue():
    assert C.Source("sts", "a/b", config="c", split="dev").path("/r/") == "/r/a__b__c/dev.parquet"
    default = C.default_catalogue()
    assert [s.group for s in default].count("sts") == 4 and default[8].lang == "en-ko"
    config = {"datasets": {"bitext": [{"name": "x"}], "sts": [{"name": "y", "lang": "ko", "max_examples": 3}]}}
    got = C.catalogue_from_config(config)
    assert [(s.group, s.name, s.lang, s.max_examples) for s in got] == [("sts", "y", "ko", 3), ("bitext", "x", "en-ko", None)]


@pytest.mark.parametrize("limit", [None, 0, 5, 17, 100])
def test_scan_of_many_files_keeps_file_order(spark, folder, limit):
    source = C.Source("sts", "many files 100%")
    put(spark, folder, source, [(f"a{i}", f"b{i}") for i in range(40)], "sentence1 string, sentence2 string", files=5)
    scanned = C.scan_source(spark, folder, source, limit)
    files = sorted(Path(source.path(folder)).glob("*.parquet"))
    assert len(files) == 5
    want = [t for f in files for t in spark.read.parquet(str(f)).coalesce(1).toPandas()["sentence1"]][: 40 if limit is None else limit]
    got = {r.row_ord: r.sentence1 for r in scanned.collect()}
    assert got == dict(enumerate(want))


def test_load_examples_skips_missing_and_unknown(spark, folder):
    good = C.Source("sts", "good", max_examples=2)
    odd = C.Source("sts", "odd")
    put(spark, folder, good, [("a", "b"), ("c", "d"), ("e", "f")], "text1 string, text2 string")
    put(spark, folder, odd, [(1,)], "n int")
    ex = C.load_examples(spark, folder, [C.Source("sts", "gone"), odd, good])
    rows = ex.orderBy("row_ord").collect()
    assert [(r.source_seq, r.row_ord) for r in rows] == [(2, 0), (2, 1)]
    manifest = {r.name: r for r in C.ingest_manifest(spark, folder, [C.Source("sts", "gone"), odd, good]).collect()}
    assert manifest["gone"].rows == 0 and manifest["gone"].path is None and manifest["gone"].status == "error: PATH_NOT_FOUND"
    assert manifest["good"].rows == 3 and manifest["good"].status == "ok" and manifest["odd"].rows == 1


def test_partition_columns_and_odd_names_are_kept(spark, folder):
    source = C.Source("sts", "by score [x] {y}")
    rows = [(f"a{i}", f"b{i}", i % 3) for i in range(20)]
    spark.createDataFrame(rows, "sentence1 string, sentence2 string, score int").repartition(2).write.partitionBy("score").parquet(source.path(folder))
    got = C.scan_source(spark, folder, source).collect()
    assert sorted((r.sentence1, r.score) for r in got) == sorted((a, s) for a, _, s in rows)
    assert sorted(r.row_ord for r in got) == list(range(20))
    assert {r.label for r in C.load_examples(spark, folder, [source]).collect()} == {0.0, 1.0, 2.0}


def test_rows_are_not_shuffled_to_reach_their_position(spark, folder):
    """Many files, with automatic broadcasts off: only file counts are exchanged."""
    source = C.Source("sts", "many files [x]")
    put(spark, folder, source, [(f"a{i}", f"b{i}") for i in range(300)], "sentence1 string, sentence2 string", files=23)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = C.scan_source(spark, folder, source)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin [_file" not in plan
        assert not any("Exchange" in line and "sentence1" in line for line in plan.splitlines())
        order = [r.sentence1 for r in whole.orderBy("row_ord").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(order) == sorted(f"a{i}" for i in range(300))
    for limit in (0, 1, 40, 299, 1000):
        first = C.scan_source(spark, folder, source, limit)
        assert [r.sentence1 for r in first.orderBy("row_ord").collect()] == order[:limit]
    assert len(C.scan_source(spark, folder, source, 20).inputFiles()) <= 3


def test_a_cap_keeps_partition_columns(spark, folder):
    source = C.Source("sts", "by part {y}")
    rows = [(f"a{i}", i % 3, f"k/{i % 2} %[z]") for i in range(30)]
    spark.createDataFrame(rows, "t string, score int, kind string").repartition(2).write.partitionBy("kind", "score").parquet(source.path(folder))
    whole = C.scan_source(spark, folder, source).orderBy("row_ord").collect()
    assert sorted((r.t, r.score, r.kind) for r in whole) == sorted(rows)
    assert C.scan_source(spark, folder, source, 11).orderBy("row_ord").collect() == whole[:11]


def test_manifest_counts_all_sources_in_one_job(spark, folder):
    sources = [C.Source("sts", f"s{i}") for i in range(6)] + [C.Source("sts", "gone")]
    for i, source in enumerate(sources[:-1]):
        put(spark, folder, source, [("a", "b")] * (i + 1), "text1 string, text2 string", files=2)
    def counted(some, group):
        spark.sparkContext.setJobGroup(group, "")
        try:
            rows = sorted(C.ingest_manifest(spark, folder, some).collect())
        finally:
            spark.sparkContext.setJobGroup("", "")
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    rows, jobs_of_seven = counted(sources, "seven")
    assert [(r.rows, r.status) for r in rows] == [(i + 1, "ok") for i in range(6)] + [(0, "error: PATH_NOT_FOUND")]
    # One query; adaptive execution runs its exchanges as jobs, as many for two sources as for seven.
    assert jobs_of_seven == counted(sources[:2], "two")[1]


def test_an_unreadable_source_becomes_a_status(spark, folder):
    good, bad, late = C.Source("sts", "good"), C.Source("sts", "bad"), C.Source("sts", "late")
    for source in (good, late):
        put(spark, folder, source, [("a", "b")], "text1 string, text2 string", files=1)
    Path(bad.path(folder)).parent.mkdir(parents=True)
    Path(bad.path(folder)).write_bytes(b"no parquet at all")
    next(Path(late.path(folder)).glob("*.parquet")).write_bytes(b"PAR1 broken PAR1")
    got = {r.name: (r.rows, r.status) for r in C.ingest_manifest(spark, folder, [bad, late, good]).collect()}
    assert got["good"] == (1, "ok") and got["bad"][0] == got["late"][0] == 0
    assert got["bad"][1].startswith("error: ") and got["late"][1].startswith("error: ")


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_manifest_document(spark, folder):
    good = C.Source("sts", "good", max_examples=1)
    put(spark, folder, good, [(f"a{i}", "b") for i in range(5)], "text1 string, text2 string")
    entries = [good, C.Source("bitext", "gone", lang="en-ko")]
    document = C.manifest_document(C.ingest_manifest(spark, folder, entries), ["en", "ko"], ["sts"])
    tables.write_report(document, f"{folder}/manifest")
    got = json.loads(next(Path(f"{folder}/manifest").glob("*.json")).read_text())
    assert got["languages"] == ["en", "ko"] and got["tasks"] == ["sts"] and got["created_at"].endswith("Z")
    # Ingest keeps twice the cap.
    assert [(d["name"], d["rows"], d["status"]) for d in got["datasets"]] == [
        ("good", 2, "ok"), ("gone", 0, "error: PATH_NOT_FOUND"),
    ]


def test_fallback(spark, folder):
    empty = C.load_examples(spark, folder, [C.Source("sts", "gone")])
    rows = C.with_fallback(empty).orderBy("row_ord").collect()
    assert [r.example_id for r in rows] == [e[0] for e in K.FALLBACK_EXAMPLES]
    full = frame(spark, [example(0, 0, "sts", ["a", "b"], ["sentence_a", "sentence_b"])])
    assert C.with_fallback(full).count() == 1


def test_shards_roundtrip(spark, folder):
    ex = random_examples(spark, 230)
    tables.write_shards(ex, f"{folder}/s", 60)
    train, fell_back = tables.read_shards(spark, f"{folder}/s", "train")
    assert train.count() == 228 and not fell_back
    sizes = sorted(r["count"] for r in train.groupBy("shard").count().collect())
    assert sizes == [48, 60, 60, 60]
    everything, fell_back = tables.read_shards(spark, f"{folder}/s", "test")
    assert everything.count() == 230 and fell_back
    third = ex.orderBy("source_seq", "row_ord").collect()[2 + 3]
    assert tables.example_at(train, 3).first().row_ord == third.row_ord
    with pytest.raises(FileNotFoundError):
        tables.read_shards(spark, f"{folder}/none")


def files_of(folder, split):
    """Shard number in the name, and its file, of every shard of a split."""
    return {int(f.name.split("-")[1]): f for f in Path(f"{folder}/split={split}").glob("*.parquet")}


def test_shard_files_are_numbered_and_in_order(spark, folder):
    ex = random_examples(spark, 230)
    want = [(r.source_seq, r.row_ord) for r in ex.orderBy("source_seq", "row_ord").collect()]
    tables.write_shards(ex.repartition(7), f"{folder}/n", 60)
    for split, rows in (("val", want[:2]), ("train", want[2:])):
        files = files_of(f"{folder}/n", split)
        assert sorted(files) == list(range(-(-len(rows) // 60)))
        for n, file in files.items():
            got = pq.ParquetFile(file).read()
            assert list(zip(got["source_seq"].to_pylist(), got["row_ord"].to_pylist())) == rows[60 * n : 60 * n + 60]
            assert got["pos"].to_pylist() == list(range(60 * n, 60 * n + len(got))) and set(got["shard"].to_pylist()) == {n}
    # Written again with fewer rows, nothing of the first remains; an empty frame leaves no shard.
    tables.write_shards(ex.limit(50), f"{folder}/n", 60)
    assert sorted(p.name for p in Path(f"{folder}/n").iterdir() if p.is_dir()) == ["split=train"]
    assert tables.read_shards(spark, f"{folder}/n", "val")[0].count() == 50
    tables.write_shards(ex.limit(0), f"{folder}/n", 60)
    assert not list(Path(f"{folder}/n").rglob("*.parquet"))


def test_ten_thousand_shards_in_one_folder(spark, folder):
    """Few writers, several shards each, named by writer and count; texts are shuffled once."""
    ex = spark.range(20_200, numPartitions=8).selectExpr(
        "CAST(id % 3 AS INT) AS source_seq", "id AS row_ord", "CAST(id AS STRING) AS example_id", "'sts' AS task", "'en' AS lang",
        "array('a', 'b') AS texts", "array('sentence_a', 'sentence_b') AS roles", "array('d', 'd') AS teacher_prompt_names",
        "array('d', 'd') AS student_prompt_names", "CAST(NULL AS DOUBLE) AS label", "array('i', 'j') AS text_ids",
    )
    tables.write_shards(ex, f"{folder}/many", 2, writers=64)
    files = list(Path(f"{folder}/many/split=train").glob("*.parquet"))
    assert len(files) == 9_999 and {p.name for p in Path(f"{folder}/many").iterdir() if p.is_dir()} == {"split=train", "split=val"}
    train, _ = tables.read_shards(spark, f"{folder}/many", "train")
    n, sizes = train.groupBy("shard").count().agg(F.count("*"), F.max("count")).first()
    assert (n, sizes) == (9_999, 2)
    key = lambda f: (int(f.name.split("-")[1]), int(f.name.split(".c")[1].split(".")[0]))
    numbers = [pq.ParquetFile(f).read(columns=["shard"])["shard"][0].as_py() for f in sorted(files, key=key)]
    assert numbers == list(range(9_999))


def test_checksums(spark, folder):
    tables.write_texts(spark.createDataFrame([("i", "t", "en")], "text_id string, text string, lang string"), f"{folder}/t")
    assert [r.text for r in tables.iter_texts(tables.read_texts(spark, f"{folder}/t"))] == ["t"]
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in tables.file_checksums(spark, f"{folder}/t").collect()}
    want = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(f"{folder}/t").glob("*.parquet")}
    assert got == want


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_checksums_by_pieces(spark, folder):
    """Ordered pieces of many files, empty ones and odd names among them."""
    data = {"a.bin": b"", "b c%20[1].bin": b"xyz", "é.bin": bytes(range(256)) * 10, "d.bin": b"0123456789" * 100}
    for name, content in data.items():
        Path(f"{folder}/{name}").write_bytes(content)
    Path(f"{folder}/other.txt").write_text("not asked for")
    cut = {name: [c[i : i + 1000] for i in range(0, len(c), 1000)] for name, c in data.items() if c}
    pieces = tables.piece_checksums(spark, folder, "*.bin", piece_bytes=1000).collect()
    got = {(r.path.rsplit("/", 1)[1], r.piece): (r.start, r.bytes, r.sha256) for r in pieces}
    assert got == {(n, i): (1000 * i, len(p), sha(p)) for n, ps in cut.items() for i, p in enumerate(ps)}
    files = {r.path.rsplit("/", 1)[1]: (r.bytes, r.pieces, r.sha256) for r in tables.file_checksums(spark, folder, "*.bin", 1000).collect()}
    root = {n: sha(ps[0]) if len(ps) == 1 else sha(b"".join(hashlib.sha256(p).digest() for p in ps)) for n, ps in cut.items()}
    assert files == {n: (len(data[n]), len(cut[n]), root[n]) for n in cut}
    assert tables.file_checksums(spark, folder, "*.none").count() == 0


def test_checksums_of_a_file_above_two_gigabytes(spark, folder):
    """A sparse file of 2.5 GB: more than one cell can hold."""
    size, piece = (5 << 29) + 3, 1 << 28
    with open(f"{folder}/big.bin", "wb") as file:
        file.truncate(size)
    row = tables.file_checksums(spark, folder, "*.bin", piece).first()
    whole, rest = hashlib.sha256(bytes(piece)).digest(), hashlib.sha256(bytes(3)).digest()
    assert (row.bytes, row.pieces, row.sha256) == (size, 11, sha(whole * 10 + rest))


def test_content_digests_ignore_order_and_files(spark):
    rows = [(1, "a", 0.5, ["x", None]), (1, "b", None, []), (1, "b", None, []), (2, None, 1.0, None), (2, "", 1.0, [""])]
    schema = "g int, t string, v double, l array<string>"

    def digest(rows, parts=3):
        return sorted(tuple(r) for r in tables.content_digests(spark.createDataFrame(rows, schema).repartition(parts), ["g"], ["t", "v", "l"]).collect())

    assert digest(rows) == digest(rows[::-1], 1)
    for changed in (rows[:-1], rows + rows[1:2], [*rows[:-1], (2, "", 1.0, [])], [*rows[:-2], (2, "", 1.0, None), (2, "", 1.0, [""])]):
        assert digest(changed) != digest(rows)
    assert digest([(1, "a|b", None, ["c"])]) != digest([(1, "a", None, ["b|c"])])
    assert digest([(1, "a", None, ["b", "c"])]) != digest([(1, "a", None, ["b,c"])])
    assert tables.content_digests(spark.createDataFrame(rows, schema).limit(0), ["g"]).count() == 0


def test_embeddings_roundtrip(spark, folder):
    emb = vectors(spark, {"a": [1, 2], "b": [3, 4]}).unionByName(vectors(spark, {"a": [5, 6]}, "query"))
    tables.write_embeddings(emb, f"{folder}/e", files=2)
    back = tables.read_embeddings(spark, f"{folder}/e")
    assert sorted((r.kind, r.text_id, r.vec) for r in back.collect()) == [("doc", "a", [1, 2]), ("doc", "b", [3, 4]), ("query", "a", [5, 6])]
    assert tables.embedding_meta(back).first().asDict() == {"n": 2, "dim": 2, "dtype": "float16", "n_query": 1}
    fine = vectors(spark, {"a": [1, 0.1]})
    assert tables.embedding_meta(fine).first().dtype == "float32"
    tables.write_embedding_meta(tables.embedding_meta(back), f"{folder}/e", model="m")
    assert tables.read_embedding_meta(spark, f"{folder}/e").first().asDict() == {"n": 2, "dim": 2, "dtype": "float16", "n_query": 1, "model": "m"}
    assert tables.read_embeddings(spark, f"{folder}/e").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_embeddings(spark, f"{folder}/none")


def test_bucketed_vectors_are_not_shuffled(spark, folder):
    emb = vectors(spark, {f"k{i}": [i, 1] for i in range(40)})
    table = tables.save_embedding_table(emb, "pf_vectors", f"{folder}/bucketed", 4)
    refs = spark.createDataFrame([(i, f"k{i % 50}") for i in range(100)], "row int, text_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.lookup_vectors(refs, table, ["row"], hot={})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert found.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE pf_vectors")


def test_registries(spark):
    ex = frame(spark, [
        example(0, 0, "sts", ["a"], ["query"], lang="en"),
        example(0, 1, "reranking", ["a"], ["query"], lang="ko"),
        example(0, 2, "bitext", ["a"], ["query"], lang="en-fr"),
        example(0, 3, "sts", ["a"], ["query"], lang="fr"),
    ])
    got = {r.row_ord: (r.student_prompt, r.teacher_prompt_doc) for r in registry.with_task_settings(ex).collect()}
    assert got == {0: ("sts", "document"), 2: ("bitext", "bitext_query"), 3: ("sts", "document")}
    assert [r.row_ord for r in registry.outside_languages(ex).collect()] == [3]
    assert sorted(r.row_ord for r in registry.outside_languages(ex, active=["ko"]).collect()) == [0, 2, 3]
    own = {"sts": {"student_prompt": "s", "teacher_prompt_doc": "d"}, "bitext": {"enabled": False}, "reranking": {}}
    got = {r.row_ord: (r.student_prompt, r.teacher_prompt_doc) for r in registry.with_task_settings(ex, own).collect()}
    assert got == {0: ("s", "d"), 1: (None, None), 3: ("s", "d")}
    assert {r.row_ord for r in registry.with_task_settings(ex, own, active=["sts"]).collect()} == {0, 3}
    assert [r.row_ord for r in registry.outside_languages(ex, languages={"fr": {"name": "French"}, "en": {"enabled": False}}).collect()] == [0, 1, 2]


def _encoder():
    # Defined inside, so that it travels to the tasks by value.
    def factory():
        return lambda texts: np.array([[len(t), t.count("a") + 1, t.count("s")] for t in texts], float)

    return factory


def test_whole_chain(spark, folder):
    sts, ret = C.Source("sts", "pairs"), C.Source("retrieval", "x/msmarco-small")
    put(spark, folder, sts, [(f"s {i % 40} a", f"t{'a' * (i % 7)}", float(i % 6)) for i in range(120)], "sentence1 string, sentence2 string, score double")
    put(spark, folder, ret, [(f"query {i}", f"answer {'a' * i}", f"no {i}") for i in range(30)], "query string, pos string, neg string")
    summary = jobs.build_corpus(spark, folder, [sts, C.Source("sts", "gone"), ret], f"{folder}/corpus", per_shard=50).first()
    assert summary.n_examples == 150 and summary.languages == ["en"] and summary.tasks == ["retrieval", "sts"]
    report = json.loads(next(Path(f"{folder}/corpus/summary").glob("*.json")).read_text())
    assert report["n_texts"] == summary.n_texts
    meta = jobs.embed_corpus(spark, f"{folder}/corpus", f"{folder}/emb", _encoder()).first()
    assert meta.n == summary.n_texts and meta.dim == 3 and meta.n_query > 0
    teacher = tables.read_embeddings(spark, f"{folder}/emb")
    train, _ = tables.read_shards(spark, f"{folder}/corpus/examples", "train")
    losses = jobs.measure_alignment(train, teacher, _encoder(), batch_size=16, max_texts=40)
    assert losses.count() == 9 and losses.filter(F.col("n_valid") <= 40).count() == 9
    out = jobs.evaluate_model(spark, f"{folder}/corpus", _encoder(), f"{folder}/eval", languages=["en"]).first()
    assert out.sts[0].n == 1 and out.retrieval.n == 0 and not out.fallback


def test_settings_of_all_jobs_come_from_one_mapping():
    config = {
        "languages": {"active": ["en"]}, "tasks": {"later": ["reranking"]}, "max_length": 128,
        "datasets": {"sts": [{"name": "a/b", "max_examples": 3}]}, "caps": {"max_unique_texts": 9, "examples_per_shard": 4},
        "prompts": {"student": {"ret": "find: "}}, "loss": {"temperature": 0.1, "lambda_disp": 0.5},
        "train": {"batch_size": 7, "target_embeddings_n": 20, "seed": 1, "log_every": 5}, "embed": {"batch_size": 16},
        "eval": {"retrieval_proxy_size": 11},
    }
    s = JobSettings.from_config(config)
    assert [(c.name, c.max_examples) for c in s.catalogue] == [("a/b", 3)] and s.later_tasks == ["reranking"] and s.tasks == list(K.ACTIVE_TASKS)
    assert s.build == {"max_unique": 9, "per_shard": 4} and s.report == {"every": 5}
    assert {k: s.embed[k] for k in ("batch_size", "max_length")} == {"batch_size": 16, "max_length": 128}
    assert {k: s.align[k] for k in ("batch_size", "max_texts", "seed")} == {"batch_size": 7, "max_texts": 20, "seed": 1}
    assert (s.align["settings"].temperature, s.align["settings"].lambda_disperse) == (0.1, 0.5)
    assert s.evaluate["limit"] == 11 and s.evaluate["languages"] == ["en"] and s.evaluate["prompts"].student["ret"] == "find: "
    empty = JobSettings.from_config({})
    assert empty.build == {} and empty.catalogue == [] and "batch_size" not in empty.align and "limit" not in empty.evaluate
    with pytest.raises(TypeError):
        JobSettings.from_config([1])


def test_jobs_take_the_settings_and_leave_nothing_staged(spark, folder):
    source = C.Source("sts", "pairs")
    put(spark, folder, source, [(f"s {i % 40}", f"t {i}", float(i % 6)) for i in range(150)], "sentence1 string, sentence2 string, score double")
    s = JobSettings.from_config({"caps": {"examples_per_shard": 40}, "train": {"batch_size": 8, "target_embeddings_n": 16}, "embed": {"batch_size": 4}})
    before = set(Path(shared_dir(spark)).iterdir())
    out = f"{folder}/corpus"
    assert jobs.build_corpus(spark, folder, [source], out, **s.build).first().n_examples == 150
    jobs.embed_corpus(spark, out, f"{folder}/teacher", _encoder(), **s.embed)
    report = jobs.evaluate_model(spark, out, _encoder(), f"{folder}/report", **s.evaluate)
    assert report.first().retrieval.n == 0 and report.first().retrieval.available == 0
    assert set(Path(shared_dir(spark)).iterdir()) == before
    train, _ = tables.read_shards(spark, f"{out}/examples", "train")
    losses = jobs.measure_alignment(train, tables.read_embeddings(spark, f"{folder}/teacher"), _encoder(), **s.align)
    assert losses.filter("n = 16").count() == losses.count() > 0


def test_invalid_examples_are_set_aside(spark, folder, monkeypatch):
    rows = [example(0, i, "sts" if i % 10 else "translation", ["a", f"b{i}"], ["sentence_a", "sentence_b"]) for i in range(60)]
    rows += [example(0, 60, "sts", [" ", "b"], ["sentence_a", "sentence_b"])]
    monkeypatch.setattr(jobs, "load_examples", lambda *a: frame(spark, rows, ids=False))
    with pytest.raises(Exception, match="invalid example"):
        jobs.build_corpus(spark, folder, [], f"{folder}/c")
    assert jobs.build_corpus(spark, folder, [], f"{folder}/c", quarantined=True).first().n_examples == 54
    errors = {r.error: r.n for r in spark.read.json(f"{folder}/c/errors").collect()}
    assert errors.pop("ok") == 54 and sum(errors.values()) == 7 and len(errors) == 2
    assert sorted(r.row_ord for r in spark.read.parquet(f"{folder}/c/rejected").collect()) == [0, 10, 20, 30, 40, 50, 60]
