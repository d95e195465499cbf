import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from helpers import brute_components

import corpus_pipeline
from quillstream.llm import decontaminate, pii, queries, tokenizer, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.scored(docs, labels).collect() if r.predicted}
    left = {i: r.text for i, r in rows.items() if i not in toxic}
    groups = brute_components(left.items(), 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    hashed = {i: set(map(tuple, zip(*[t.split()[k:] for k in range(8)], strict=False))) for i, t in left.items()}
    benchmark = {tuple(r.text.split()[k : k + 8]) for r in items.collect() for k in range(len(r.text.split()) - 7)}
    exact = {i for i, h in hashed.items() if len(h & benchmark) > 8}
    kept = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    gone = {r.doc_id for r in decontaminate.contaminated(kept, items).collect()}
    assert exact <= gone
    patterns = pii.learnt(kept.where(~kept.doc_id.isin(list(gone) or [-1])))
    want = {i: pii.mask(t, pii.Matcher(patterns)) for i, t in left.items() if i not in gone}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        ranks = tokenizer.encoder(f.read()).ranks
    t = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        assert r.ids == t.encode_ordinary(want[i]) and r.n_chars == len(want[i])


def test_all_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


LABELS, ITEMS = "doc_id bigint, quality int, toxic int", "item_id bigint, text string"


def tables(spark, folder, rows, labels=(), items=(), more=""):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + more
    for name, frame in (("documents", spark.createDataFrame(rows, schema)), ("labels", spark.createDataFrame(list(labels), LABELS)), ("benchmark", spark.createDataFrame(list(items), ITEMS))):
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(40))
    texts = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (6, "say a@b.cc"), (6, "say a@b.cc"), (None, long), (7, "one two three four five six seven eight"), (8, "x" * 300_000), (9, "held the item of the test in full"), (10, None)]
    rows = [(i, t, None if i == 9 else "en", "s", None if t is None else len(t)) for i, t in texts]
    items = [(1, "the item of the test"), (2, None), (None, "")]
    sf = tables(spark, tmp_path / "a", rows, [(4, None, None), (None, 1, 1), (4711, 0, 1)], items)
    got = sorted(((r.doc_id or 0, r.n_chars, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()), key=str)
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        bpe = tokenizer.encoder(f.read())
    kept = [(1, None), (2, ""), (3, " \n"), (4, long), (6, "say <EMAIL>"), (6, "say <EMAIL>"), (0, long), (7, texts[8][1]), (8, "x" * 300_000), (10, None)]
    assert got == sorted(((i, None if t is None else len(t), len(bpe.encode(t))) for i, t in kept), key=str)


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path / "a", [])
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "token_ends", "n_tokens"]
    sf = tables(spark, tmp_path / "b", [(1, "some text", "en", "s", 9)])
    assert [(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.run(spark, sf).collect()] == [(1, True)]


def test_columns_of_any_name(spark, tmp_path):
    names = ["ids", "token_ends", "n_tokens", "gone_id", "row", "may", "gone", "score", "predicted", "toxic", "spans", "item_id", "component_id", "slots", "key", "n"]
    rows = [(k, f"text of document {k} and no other like it at all", "en", "s", 46, *range(len(names))) for k in range(4)]
    sf = tables(spark, tmp_path / "a", rows, [(0, 1, 0)], [(1, "never seen anywhere here")], "".join(f", `{n}` int" for n in names))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.collect())
    assert corpus_pipeline.run(spark, sf).count() == 4


def test_one_stage_s_files_are_left(spark, tmp_path):
    sf = tables(spark, tmp_path / "a", [(1, "some text", "en", "s", 9)])
    files = corpus_pipeline.run(spark, sf).inputFiles()
    folder = Path(files[0].removeprefix("file://").removeprefix("file:")).parent
    assert [p.name for p in folder.parent.iterdir()] == ["encoding"]


def test_queries_run_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, q in queries.queries().items():
        out = q(spark, SF)
        if name not in ("op6_token_counts", "op10_decontamination"):
            assert out.count() == n, name
    assert hashlib.sha256(np.array([], "<u4").tobytes()).hexdigest().startswith("e3b0c442")
