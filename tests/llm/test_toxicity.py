import zlib

import numpy as np
import pytest

from tessella.llm import toxicity

BAD = ["vileword", "nastyone", "grimslur"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeilmnorst"), 5)) for _ in range(300)]
    out = []
    for k in range(n):
        t = list(rng.choice(words, rng.integers(5, 120)))
        if k % 6 == 0:
            for _ in range(3):
                t.insert(int(rng.integers(len(t))), str(rng.choice(BAD)).title() + ",")
        out.append((" ".join(t), int(k % 6 == 0)))
    return out


@pytest.fixture(scope="module")
def net():
    rows = texts(500, 1)
    return toxicity.fit([t for t, _ in rows], [y for _, y in rows])


def test_windows_hold_every_word():
    for n in range(1, 200):
        seen = np.zeros(n, int)
        for s in toxicity.windows_of(n):
            seen[s : s + toxicity.WINDOW] += 1
        assert seen.min() >= 1 and toxicity.windows_of(n).max() + min(n, toxicity.WINDOW) == n


def test_gradients_by_differences():
    net = toxicity.Network([b"ab", b"cde"], 3)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + 0.05
    words = [[b"ab", b"zz", b"cde"], [b"cde"] * 30]
    distinct = sorted({w for t in words for w in t})
    at, of = toxicity.laid_out(words, {w: k for k, w in enumerate(distinct, 1)})
    d = np.linspace(0.5, -1, len(of))

    def loss():
        x, _ = net.inputs(distinct)
        return float(net.scores(net.projected(x), at) @ d)

    keep, (x, made) = {}, net.inputs(distinct)
    net.scores(net.projected(x), at, keep)
    rng = np.random.default_rng(1)
    for name, g in net.gradients(x, made, at, keep, d).items():
        flat, g = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in {*rng.integers(0, len(flat), 6), int(np.abs(g).argmax())}:
            was, ends = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = was + step
                ends.append(loss())
            flat[i] = was
            assert abs((ends[0] - ends[1]) / 2e-2 - g[i]) < 2e-3 + 0.02 * abs(g[i]), name


def test_held_out_texts(net):
    rows = texts(300, 2)
    right = (toxicity.Scorer(net)([t for t, _ in rows]) >= toxicity.THRESHOLD) == np.array([y for _, y in rows], bool)
    assert right.mean() > 0.97


def test_scores_are_those_of_the_windows_one_by_one(net):
    rows = [t for t, _ in texts(40, 3)] + ["one", "", " .,!", "a b " * 50]
    scorer, want = toxicity.Scorer(net), []
    for t in rows:
        words = toxicity.words_of(t)
        logits = [-np.inf]
        for s in toxicity.windows_of(len(words)) if words else []:
            part = words[s : s + toxicity.WINDOW]
            at = np.zeros((1, toxicity.WINDOW), np.int64)
            at[0, : len(part)] = np.arange(1, len(part) + 1)
            logits.append(float(net.scores(net.projected(net.inputs(part)[0]), at)[0]))
        want.append(1 / (1 + np.exp(-max(logits))))
    assert np.allclose(scorer(rows), want, atol=1e-5)


def test_whole_query(spark, tmp_path):
    rows = texts(700, 4)
    clean = " ".join(t for t, y in rows if not y)
    extra = [(1000, None), (1001, ""), (1002, "\n . "), (1003, clean[:100_000] + " Nastyone vileword grimslur"), (None, rows[0][0]), (1004, rows[0][0]), (1004, rows[0][0])]
    docs = [(k, t, "x", 1.0) for k, (t, _) in enumerate(rows)] + [(k, t, "x", 1.0) for k, t in extra]
    labels = [(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (3, None), (1, 0), (1001, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in by.items() if k is not None) and by[None]["held_out"] is False
    assert all(by[k]["score"] == 0 and by[k]["predicted"] == 0 for k in (1000, 1001, 1002))
    assert by[1003]["predicted"] == 1 and by[None]["score"] == by[1004]["score"] == by[0]["score"]
    held = [(by[k]["predicted"], y) for k, (_, y) in enumerate(rows) if by[k]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op12_toxicity(spark, str(tmp_path)).collect() == []
