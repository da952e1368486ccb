"""The corpus pipeline, end to end and stage by stage, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sedimo.llm import mixing, shared, toxicity
from test_operators import WORDS, plain_lines, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents():
    rng = random.Random(31)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = []
    for i in range(240):
        text = "\n".join(prose(rng.randrange(12, 40)) for _ in range(rng.randrange(1, 5)))
        if i % 6 == 0:
            text += "\nAll rights reserved."
        if i % 8 == 0:
            text += " vile rotten foul vile"
        texts.append(text)
    for i in range(100):  # edited copies: similar by 0.8 or more if few words change
        w = [f"u{rng.getrandbits(30)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(w))
        edits = rng.choice([1, 2, 4])
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.getrandbits(30)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n ", "one", texts[3], texts[3], texts[240], prose(5000), "ünï 日本 " * 20]
    rows = [(i, t, "en", [None, "web", "books"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[5], None, None, None), (None, None, None, None, None), rows[9]]  # without an id, and a repeated row
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = made_documents()
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in rows[:240]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage has made of the one before's rows; the documents first."""
    docs = [shared.read_table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(shared.save(stage(spark, docs[-1], sf_dir), name.replace(" ", "-")))
    return docs


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.train(stages[0], shared.read_table(spark, sf_dir, "labels"))
    score = lambda t: 1 / (1 + np.exp(-sum(model.get(int(i), 0.0) for i in toxicity.features(t))))
    assert rows_of(stages[1]) == Counter({r: n for r, n in rows_of(stages[0]).items() if score(r[1]) < 0.5})
    gone = rows_of(stages[0]) - rows_of(stages[1])
    assert sum("vile" in r[1] for r in gone) >= 25 and all("vile" in r[1] for r in gone)


def test_frequent_lines_go(stages):
    before = [tuple(r) for r in stages[1].collect()]
    want = Counter()
    for r, (_, _, dropped, text) in zip(before, plain_lines([r[:2] for r in before], 10)):
        want[(r[0], text, r[2], r[3], len(text) if dropped else r[4])] += 1
    assert rows_of(stages[2]) == want and not any("rights reserved" in r[1] for r in want)


def shingles(text, width=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_one_document_of_each_near_duplicate_group_stays(stages):
    rows = [tuple(r) for r in stages[2].collect()]
    named = sorted({r[0]: r for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:3])) if r[0] is not None}.values())
    sets = [shingles(r[1]) for r in named]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            holders[x].append(i)
    group = list(range(len(named)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs, edited = {(i, j) for own in holders.values() if len(own) < 100 for i in own for j in own if i < j}, 0
    for i, j in sorted(pairs):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            edited += sets[i] != sets[j]
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    assert edited >= 60
    kept = Counter(r[0] for r in rows_of(stages[3]).elements())
    assert kept.pop(None) == 2  # rows without an id can't be named by a group
    assert kept == Counter(named[i][0] for i in range(len(named)) if find(i) == i)


def test_the_mix_takes_words_as_often_as_told(stages):
    taken, got = Counter(), Counter()
    for r in mixing.mix(stages[3]).collect():
        taken[r.doc_id] += r.taken
    texts = defaultdict(list)
    for r in stages[3].collect():
        texts[r.doc_id].append(words_of(r.text))
    for r in stages[4].collect():
        w = words_of(r.text)
        got[r.doc_id] += len(w)
        assert any(w == own[: len(w)] for own in texts[r.doc_id]) and r.n_chars == len(r.text)
    assert got == Counter({k: n for k, n in taken.items() if n})


def test_packing_holds_every_id_once(stages):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = exact.encode(r.text, add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = np.array(ids[s : s + 2048], "<u4")
            want[r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = stages[5].collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(filled.values()) > 0.8 * 2048 * len(filled)


def test_run_is_its_stages_and_leaves_one_table(spark, sf_dir, stages):
    before = shared.made()
    out = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(out.select(columns)) == rows_of(stages[5].select(columns))
    assert shared.made() == before + 1
    shared.discard(out)
    assert shared.made() == before


def test_no_documents_give_no_rows(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        shared.read_table(spark, sf_dir, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
