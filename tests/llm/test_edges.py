"""Every operator and stage on one table of nulls, empty, very long and repeated rows and clashing names, and on empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import ann, chat, decontaminate, licenses, linededup, minhash, packing, quality, runs, simhash, substrings, tokencount, toxicity, vectorcodes

#: Names that the operators use inside.
CLASHES = "_k1 _k2 uid row _c _at _n _lines line_dedup k y w h g x p n fp root node id key h1 h2 pos long shard b score _score _lang held_out v d r c depth a start length item_id".split()
LONG = "word " * 30000 + "end"
PASSAGE = " ".join(f"passage{i}" for i in range(80))


@pytest.fixture(scope="module")
def nasty(spark):
    """Rows of (doc_id, text, lang, source, n_chars) with other columns under names of the operators' own."""
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "the same text here\nand a second line of it"), (6, "the same text here\nand a second line of it")]
    rows += [(7, "the same text here\nand a second line of it"), (None, None), (8, f"x {PASSAGE}"), (9, f"y {PASSAGE} z"), (10, "mit license <|im_end|>"), (10, "another text of this key")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(k, t, None if k == 4 else "en", "s", 0, *(["q"] * len(CLASHES))) for k, t in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i % 9, i % 2, int(i % 3 == 0), "z") for i in range(20)] + [(None, 1, 1, "z"), (1, None, None, "z")], "doc_id long, quality int, toxic int, k string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE, 2), (1, PASSAGE, 2), (None, None, 3), (2, "", 4)], "item_id long, text string, h int")


def size(df):
    return len(df.collect())


def test_filters_and_edits_keep_all_columns(nasty, labels, benchmark):
    n = nasty.count()
    for f, least, most in (
        (lambda d: linededup.dedup_lines(d).select(d.columns), n, n),
        (simhash.keep_one, 5, n - 3),
        (minhash.keep_one, 5, n - 3),
        (lambda d: decontaminate.clean(d, benchmark), n - 2, n - 2),
        (lambda d: toxicity.accepted(d, labels), 0, n),
    ):
        out = f(nasty)
        assert out.columns == nasty.columns
        assert least <= size(out) <= most
        assert size(f(nasty.limit(0))) == 0


def test_results_have_a_row_for_each_document(nasty, labels):
    n = nasty.count()
    for f in (simhash.near_duplicates, licenses.scan, substrings.remove_duplicates, lambda d: quality.classify(d, labels), lambda d: toxicity.classify(d, labels)):
        assert size(f(nasty)) == n
        assert size(f(nasty.limit(0))) == 0


def test_values_of_empty_long_and_repeated_texts(nasty, labels):
    """What has no words gets one and the same value, whether null, empty or blank; what repeats gets equal values."""
    texts = {r.doc_id: r.text for r in nasty.where("doc_id < 10 and doc_id <> 6").collect()}
    for f in (quality.classify, toxicity.classify):
        rows = [r for r in f(nasty, labels).collect()]
        scores = {r.doc_id: r.score for r in rows if r.doc_id is not None and r.doc_id not in (6, 10)}
        assert scores.keys() == texts.keys() and len({scores[k] for k in (1, 2, 3)}) == 1
        assert scores[4] == scores[5] and all(0 <= r.score <= 1 for r in rows)
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(nasty).collect() if r.doc_id is not None}
    assert near[1] == near[2] == near[3] == ("0" * 16, 1) and near[4] == near[5] and near[4][1] == 4
    held = {r.doc_id: r.labels for r in licenses.summary(licenses.scan(nasty)).where("labels = 'mit'").collect()}
    assert held == {10: "mit"}
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.remove_duplicates(nasty).collect()}
    assert cut[4, len(LONG)] == cut[5, len(LONG)] == len(LONG) and cut[1, 0] == cut[2, 0] == 0


def test_tokens_and_runs(nasty):
    counts = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(nasty, public_tokenizers.path("byte_bpe_50k.json")).collect()]
    assert len(counts) == nasty.count()
    assert {c[1:] for c in counts if c[0] in (1, 2)} == {(0, 0, False)} and {c for c in counts if c[0] in (4, 5)} == {(k, len(LONG), 30001, True) for k in (4, 5)}
    found = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(nasty).collect()}
    assert found[4, 30001] == found[5, 30001] == ([(0, 30000, 1)], "word end") and found[1, 0] == found[3, 0] == ([], "")
    assert len(runs.digests(runs.periodic_runs(nasty)).collect()) == nasty.count()
    assert runs.planted(nasty).columns == ["doc_id", "text"] and size(runs.planted(nasty)) == nasty.count()


def test_codes(spark):
    names = "row, v, codes, p, e, n, s, _l, _s, _d, _e, label_error".split(", ")
    df = spark.createDataFrame([(1, [1.0] * 4, None, *names), (1, [1.0] * 4, None, *names), (2, None, 3, *names), (None, [2.0] * 4, 3, *names)], "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in names))
    out = vectorcodes.with_label_error(vectorcodes.encode(df), codes="_codes")
    assert out.columns == [*df.columns, "_codes", "_label_error"]
    # The one entry that starts moves to the mean of all three: floor(4096 / 3) for 1024, 1024 and 2048.
    assert sorted((r.vec_id or 0, r._codes.code, r._codes.error, r._label_error) for r in out.collect()) == [(0, "00000000", 4 * 683**2, 4 * 683**2), (1, "00000000", 4 * 341**2, 8 * 341**2)] + [(1, "00000000", 4 * 341**2, 8 * 341**2)]


def test_pairs_and_pieces(nasty, benchmark):
    found = decontaminate.contaminated(nasty, benchmark)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found.collect()) == [(8, 1, 0)] * 2 + [(9, 1, 0)] * 2
    assert size(decontaminate.contaminated(nasty, benchmark.limit(0))) == size(decontaminate.contaminated(nasty.limit(0), benchmark)) == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(nasty, path, keep_ids=True).collect()
    assert sum(r.start == 0 for r in rows) == nasty.count() and all(len(r.ids) == r.length for r in rows)
    assert size(packing.pack(nasty.limit(0), path)) == 0


def test_vectors(spark):
    names = "id, d, v, row, query_id, rank, score, norm".split(", ")
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (40, [])]
    df = spark.createDataFrame([(*r, *names) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in names))
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 1, 1.0)]
    assert size(ann.nearest(df.limit(0), df)) == size(ann.nearest(df, df.limit(0))) == 0


def test_turns(spark):
    names = "a, b, c, uid, depth, segment, h1, length, position, r, pid, start".split(", ")
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, LONG), (None, 0, "assistant", "x"), (None, 1, "user", ""), (3, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, *names) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in names))
    nodes, convs = chat.prefix_tree(df)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(nodes, convs).collect()}
    assert got == {1: (3, 0), 2: (1, 0), None: (2, 1), 3: (1, 0)}
    assert size(nodes) == 6


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, nasty, labels, benchmark, name, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    labels.write.parquet(f"{at}/labels.parquet")
    benchmark.write.parquet(f"{at}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, nasty, str(at))
    rows = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == nasty.count()
    else:
        assert out.columns == nasty.columns and len(rows) <= nasty.count()
    if name == "line_dedup":
        assert len(rows) == nasty.count()
    if name == "simhash_dedup":
        # Null, empty and blank texts are one component, the long ones another, and so are the three equal ones and both ends of the passage's.
        assert sorted(str(r.doc_id) for r in rows) == ["1", "10", "10", "4", "6", "8", "None"]
    if name == "decontaminate":
        assert len(rows) == nasty.count() - 2
    assert size(stage(spark, nasty.limit(0), str(at))) == 0
