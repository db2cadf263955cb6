"""Random corpora around the thresholds, against brute force."""

import numpy as np
import pytest

from inkwell.llm import decontaminate, near, repeats
from tests.llm.test_operators import classes_by_force, removed_by_force


@pytest.mark.parametrize(("seed", "frequent", "block"), [(1, 32, 2_000_000), (2, 2, 2_000_000), (3, 2, 50)])
def test_near_copies(spark, seed, frequent, block):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    passage, docs = draw(60), []
    for _ in range(25):
        base = draw(int(rng.choice([5, 6, 7, 9, 12, 20, 44, 90, 250])))
        if rng.random() < 0.3:
            base = passage[: int(rng.integers(10, 60))] + base[: max(1, len(base) // 3)]
        docs.append(base)
        for _ in range(int(rng.integers(2, 9))):
            d = list(docs[-1] if rng.random() < 0.5 else base)
            for _ in range(int(rng.integers(0, len(d) // 25 + 2))):
                p, kind = int(rng.integers(0, len(d))), rng.random()
                if kind < 0.4:
                    d[p] = draw(1)[0]
                elif kind < 0.7:
                    d.insert(p, draw(1)[0])
                elif len(d) > 1:
                    del d[p]
            docs.append(d)
    texts = {int(i): " ".join(docs[k]) for i, k in enumerate(rng.permutation(len(docs)))}
    got = near.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), near.Settings(frequent=frequent, block_shingles=block)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_force(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rng = np.random.default_rng(seed)
    pool, texts = [], {}
    for i in range(200):
        parts = []
        for _ in range(int(rng.integers(1, 8))):
            if pool and rng.random() < 0.5:
                x = pool[int(rng.integers(0, len(pool)))]
                a = int(rng.integers(0, max(1, len(x) - 1)))
                parts.append(x[a : a + int(rng.choice([20, 48, 49, 50, 51, 52, 60, 100, 200]))])
            else:
                letters = ("ab", "abcdefgh ", "aé漢 ", "0")[int(rng.integers(0, 4))]
                pool.append("".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(1, 250)))))
                parts.append(pool[-1])
        texts[3 * i] = "".join(parts)
    got = repeats.removed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), repeats.Settings(flush=700)).collect()
    assert {r["doc_id"]: (r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got} == removed_by_force(texts)


def overlaps_by_force(text, items, settings):
    """(item, words alike) of the best run of every item at every shift."""
    words, out = text.split(), {}
    for i, item in items.items():
        own, best = item.split(), 0
        for shift in range(1 - len(own), len(words)):
            total = low = top = 0
            alike = at_low = 0
            for k, w in enumerate(own):
                if 0 <= shift + k < len(words):
                    same = words[shift + k] == w
                    total += 1 if same else -2
                    alike += same
                    if total < low:
                        low, at_low = total, alike
                    if total - low > top:
                        top = total - low
                        found = alike - at_low
                        best = max(best, found)
        if best >= settings.min_same or (len(own) < settings.min_same and f" {item} " in f" {text} " and len(own) >= settings.min_item):
            out[i] = best
    return out


@pytest.mark.parametrize("block_items", [1000, 7])
def test_benchmark_passages(spark, block_items):
    """Every overlap that is reported is one, exact ones are all found, and of changed ones at least 95 of 100."""
    rng, settings = np.random.default_rng(8), decontaminate.Settings(block_items=block_items)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 4000, n)]
    items = {i: " ".join(draw(int(rng.choice([3, 5, 8, 10, 12, 15, 20, 30, 40])))) for i in range(40)}
    items[40] = items[41] = " ".join(draw(40))
    texts, exact = {}, {}
    for d in range(250):
        i = int(rng.integers(0, 42))
        own = items[i].split()
        rate = float(rng.choice([0, 0, 0.05, 0.1, 0.2, 0.25]))
        changed = ["x" + w if rng.random() < rate else w for w in own]
        if d % 10 == 0:
            changed = [w if k % 4 != 3 else "y" + w for k, w in enumerate(own)]
        if changed == own and len(own) >= settings.min_item:
            exact[d] = i
        texts[d] = " ".join([*draw(int(rng.integers(0, 60))), *changed, *draw(int(rng.integers(0, 60)))])
    texts |= {300: None, 301: "", 302: " ".join(draw(30000) + items[41].split())}
    frame = spark.createDataFrame([(d if d != 7 else None, t, "x") for d, t in texts.items()], "doc_id long, text string, overlaps string")
    bench = spark.createDataFrame([*items.items(), (None, "w1 w2 w3 w4 w5"), (90, None), (91, "")], "item_id long, text string")
    out = decontaminate.with_overlaps(frame, bench, settings)
    assert out.columns == ["doc_id", "text", "overlaps"]
    got = {r["text"]: {o["item_id"]: o["same"] for o in r["overlaps"]} for r in out.collect()}
    want = {t: overlaps_by_force(t, items, settings) if t and len(t) < 5000 else {} for t in texts.values()}
    assert all(i in got[texts[d]] for d, i in exact.items()) and {40, 41} <= set(got[texts[302]])
    pairs = {(t, i) for t, own in got.items() for i in own if t != texts[302]}
    truth = {(t, i) for t, own in want.items() for i in own}
    assert pairs <= truth and len(pairs) >= 0.95 * len(truth)
    assert {len(r["overlaps"]) for r in decontaminate.with_overlaps(frame, bench.where("false"), settings).collect()} == {0}
