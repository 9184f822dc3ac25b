"""The pipeline against a plain version of its stages."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stormlens.llm import language, mixing, queries, simhash
from stormlens.llm.common import bucket_of
from tests.llm import brute
from tests.llm.test_documents import SF, docs, odd_rows


def plain(spark, documents):
    """Pieces (doc_id, piece, start, length, crc) that the stages should give."""
    net = language.learn(documents, bucket_of("doc_id", 4) != 2)
    folded = language.Folded(net)
    rows = []
    for r in documents.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        w = language.windows_of(r.text.encode())
        size = [language.WINDOW] * (len(w) - 1) + [len(r.text.encode()) - language.WINDOW * (len(w) - 1)]
        p = (folded.probabilities(w) * [[s] for s in size]).sum(0) / sum(size)
        if p.max() >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            rows.append((r.doc_id, r.text, r.source))
    comp = brute.components([r[0] for r in rows], [brute.fingerprint(r[1]) for r in rows])
    rows = [r for r, c in zip(rows, comp) if c == r[0]]
    kept = []
    for (i, t, s), gone in zip(rows, brute.removed([r[:2] for r in rows], 20)):
        text = " ".join(w.decode() for w, g in zip(brute.words(t), gone) if not g)
        if text or not any(gone):
            kept.append((i, text, s))
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = []
    for (i, t, s), n in zip(kept, brute.copies([(i, s) for i, _, s in kept])):
        out += [(i, *p) for p in brute.pieces(tok, t)] * n
    return sorted(out)


def test_run_equals_the_plain_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    brute.check_packed([(r.sequence_id, r.offset, r.length) for r in got])


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    for rows in (odd_rows(), []):
        got = docs(spark, rows)
        cols = got.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, got, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert got.columns == cols
                path = f"{tmp_path}/{len(rows)}-{k}"
                got.write.parquet(path)
                got = spark.read.parquet(path)
        got.collect()


def test_stages_take_columns_named_like_their_own(spark):
    names = ["__gone", "__copy", "__copies", "__order", "__p", "__source", "__id", "__row", "__of", "__n", "__u"]
    rows = [(1, "one two three four", "s", *names), (1, "another text of it", "s", *names), (None, "no id here", "t", *names), (None, "nor here", None, *names)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]
    assert [tuple(r) for r in simhash.keep_one(d.repartition(3)).where("doc_id = 1").collect()] == [tuple(r) for r in kept.where("doc_id = 1").collect()]
    got = mixing.repeat(d, total=40)
    assert got.columns == d.columns and set(got.select(*names).distinct().collect()) == {tuple(names)}
    assert len(mixing.mix(d).columns) == len(d.columns)


def test_registered(spark):
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
