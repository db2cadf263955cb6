"""Queries over whole tables against brute force on small fixtures."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inkwell.plans import links, native, runs, spelling


def write_documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def test_watch_folder_whole(spark, tmp_path):
    """Every source arrives, and a new version of every document."""
    texts = ["One line.", "One line.\n", "Two.\n\n", "", None, "A b\nc", "End \n", "Über"]
    rows = [(i, texts[i // 3 % len(texts)], "en", f"src{i % 3}", 0) for i in range(3 * len(texts) * 2)]
    write_documents(spark, tmp_path, rows)

    def found(text):
        return text is not None and text.strip() and not (text.endswith("\n") and not text[:-1].endswith("\n"))

    second = {i: None if text is None else text + "\n" * (1 + i % 2) for i, text, *_ in rows}
    got = runs.watch_folder(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, text in second.items() if found(text)]
    assert {r["path"].split("/")[1] for r in got} == {"src0", "src1", "src2"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_suggestions_meet_on_keys(spark):
    """The best three by brute force; no join of all names of a folder."""
    rng = random.Random(5)
    names = ["a", "", "ab", "README.md", "über.md", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120))]
    paths = sorted({f"{rng.choice(('', 'x/', 'x/y/'))}{n}" for n in names if n} | {"x/README.md"})
    asked = sorted({f"{rng.choice(('', 'x/', 'x/y/'))}{''.join(rng.choice('abcd') for _ in range(rng.randint(1, 7)))}" for _ in range(80)} | {"x/readme.md", "x/uber.md"})
    folder = lambda p: p.rpartition("/")[0]
    out = links.suggestions(spark.createDataFrame([(x,) for x in asked], "target string"), spark.createDataFrame([(x,) for x in paths], "path string"))
    want = set()
    for t in asked:
        near = sorted((n, p) for p in paths if folder(p) == folder(t) and (n := edits(t.rpartition("/")[2].lower(), p.rpartition("/")[2].lower())) <= 2)
        want |= {(t, p, k + 1) for k, (_, p) in enumerate(near[:3])}
    assert {(r["target"], r["suggestion"], r["rank"]) for r in out.collect()} == want
    keys = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert keys and all("key" in x for x in keys)


def test_spelling_suggest_whole(spark, tmp_path):
    """Words seen one to four times, of any length, with an error anywhere, against brute force."""
    counts = {"house": 9, "mouse": 6, "horse": 5, "a": 7, "of": 6, "international": 5, "house\u00e9": 1, "hause": 3, "xouse": 2, "internationol": 4, "nternational": 1, "o": 1, "hoouse": 2, "zebra": 4, "qhorse": 1}
    rows = [(i, " ".join([w] * n), "en", "s", 0) for i, (w, n) in enumerate(counts.items())] + [(90, "house hous", "de", "s", 0), (91, None, "en", "s", 0), (92, "", "en", "s", 0)]
    write_documents(spark, tmp_path, rows)
    known = {w: n for w, n in counts.items() if n >= 5}
    want = set()
    for bad in counts.keys() - known.keys():
        near = sorted((-n, w) for w, n in known.items() if edits(bad, w) == 1)
        want |= {(bad, w, k + 1) for k, (_, w) in enumerate(near[:3])}
    got = {tuple(r) for r in native.spelling_suggest(spark, str(tmp_path)).select("word", "suggestion", "rank").collect()}
    assert got == want and {"hause", "xouse", "internationol", "qhorse"} <= {w for w, *_ in got}


TEXTS = {
    0: None, 1: "", 2: " \n", 3: "One boat. Two boats!", 4: "See e.g. the boat of J. Smith. It sank!\n", 5: "# Über uns\n\nDas 2. Boot kam an. Ça va? Ñandú 3,5 km.\n\n- Лодка ушла. Всё.\n",
    6: "A boat came in. " * 2000, 7: "No end", 8: "Line one\ngoes on. Line two.\n",
}
SENTENCES = {3: 2, 4: 2, 6: 2000, 7: 1, 8: 2}


def test_sentences_and_tokens_of_whole_texts(spark, tmp_path):
    """Null, empty, long and multilingual texts of the table: every sentence stands at its place, every letter is in a token."""
    write_documents(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in TEXTS.items()])
    found = links.sentences_of_documents(spark, str(tmp_path)).collect()
    for r in found:
        assert TEXTS[r["doc_id"]].encode()[r["b_start"] : r["b_end"]].decode() == r["text"] and r["text"].strip()
    n = Counter(r["doc_id"] for r in found)
    assert {i: n[i] for i in SENTENCES} == SENTENCES and not n.keys() & {0, 1, 2} and n[5] >= 5
    got = {(r["doc_id"], r["kind"]): (r["n"], r["bytes"]) for r in links.tokens_of_documents(spark, str(tmp_path)).collect()}
    for i in (3, 4, 6, 7, 8):
        text = TEXTS[i].rstrip()
        words, letters = re.findall(r"[^\W\d_]+(?:['’._@][^\W\d_]+)*", text), sum(v for (k, _), (_, v) in got.items() if k == i)
        assert got[i, "word"] == (len(words), sum(map(len, words))) and letters >= len(text)
    assert got[5, "number"] == (2, 4) and not {i for i, _ in got} & {0, 1}


def test_names_after_given_names(spark):
    text = {1: "Yesterday Mr Berg saw the Big Boat", 2: "with Anna Schmidt and Юрий Белов", 3: "Anna saw Thomas", 4: "the Big Anna", 5: "Peter", 6: "Łukasz Łoś met nobody"}
    tokens = spark.createDataFrame([(i, k, w) for i, t in text.items() for k, w in enumerate(t.split())], "doc_id long, place int, word string")
    got = sorted((r["doc_id"], r["name"]) for r in spelling.proper_names(tokens).collect())
    assert got == sorted([(1, "Berg"), (2, "Anna"), (2, "Schmidt"), (2, "Юрий"), (2, "Белов"), (6, "Łukasz"), (6, "Łoś")])


def test_identifiers_of_attributes(spark):
    text = """Use `frob` <a id="topbar" class='wide narrow' title="Not Names" data-x=quux>in id="outside"</a> <img alt="a > id='fake'" SRC = "pic/logo.png"><br>"""
    got = spark.createDataFrame([(text,), (None,)], "text string").select(spelling.identifiers(F.col("text")).alias("w")).collect()
    assert sorted(got[0]["w"]) == ["frob", "logo", "narrow", "pic", "png", "quux", "topbar", "wide"] and got[1]["w"] is None
