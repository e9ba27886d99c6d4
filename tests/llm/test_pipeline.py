"""The pipeline stage by stage against plain versions, and components with a hub."""

import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from .test_operators import WORDS, brute_repeats, words  # noqa: E402

from vestige.llm import simhash  # noqa: E402
from vestige.llm.components import components  # noqa: E402

rng = random.Random(11)
NOUNS = [f"{a}{b}" for a in ("sun", "moon", "tree", "river", "stone", "cloud") for b in ("", "s", "light", "side", "bed")]
PASSAGE = " ".join(f"p{k}" for k in range(60))


def prose(n):
    return " ".join(rng.choice(NOUNS) + str(rng.randrange(50)) for _ in range(n))


def _corpus():
    rows = [(k, prose(80) + (". you vilexq" + "aeo"[k % 3] + " thing. " if k % 5 == 0 else ". ") + prose(20)) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(4)] + [(210 + k, f"{prose(90)} {PASSAGE} {prose(50)}") for k in range(3)]
    return [*rows, (300, None), (301, ""), (302, "one two"), (302, "one two")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", None if i == 7 else "web", len(t or "")) for i, t in CORPUS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    marks = [(k, 1, int(k % 5 == 0)) for k in range(150)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


CORPUS = _corpus()


def linked(fps):
    """The least position of each position's group."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_every_stage_takes_effect(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "packing"]

    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in clean.collect())
    assert kept == Counter(x for x in CORPUS if x[0] >= 150 or x[0] % 5)

    first = stages["near_dedup"](spark, clean, sf_dir)
    rows = sorted(kept.elements(), key=lambda x: x[0])
    expected = [x for k, x in enumerate(rows) if linked([simhash.fingerprint(t) for _, t in rows])[k] == k]
    assert first.columns == docs.columns and Counter((r.doc_id, r.text) for r in first.collect()) == Counter(expected)

    cut = stages["substring_dedup"](spark, first, sf_dir)
    left = Counter((i, k) for (i, _), k in zip(expected, brute_repeats([words(t) for _, t in expected]), strict=True))
    assert cut.columns == docs.columns and Counter((r.doc_id, b" ".join(words(r.text))) for r in cut.collect()) == left
    assert sum("p30" in (r.text or "") for r in cut.collect()) == 0

    texts = {r.doc_id: r.text for r in cut.collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_no_stage_fails_on_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_components_with_a_hub_and_a_chain(spark):
    edges = [(5, k) for k in range(1000, 3000)] + [(k, k + 1) for k in range(10_000, 10_300)] + [(-4, 2500), (9, 9), (5, 1000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for piece in (500_000, 100):
        found = {r.node: r.component for r in components(frame, piece).collect()}
        assert found == {k: -4 for k in [-4, 5, *range(1000, 3000)]} | {k: 10_000 for k in range(10_000, 10_301)}
