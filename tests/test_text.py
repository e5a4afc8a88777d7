import random
import re

from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators import documents as D


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("r"))
    return [r.r for r in sorted(rows.collect(), key=lambda r: r.i)]


def made_words(rng, n, alphabet="bdfgkmprtvz", marks=""):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) + "".join(rng.choice(marks) for _ in range(rng.randint(0, 2) if marks else 0)) for _ in range(n)]


def test_match_keys(spark):
    """A key is blind to case, width and what stands between letters, and sees plus and number signs."""
    rng = random.Random(1)
    spelled, keys = [], []
    for word in made_words(rng, 80, "bdfgkm0123", "+#"):
        for _ in range(3):
            wide = rng.random() < 0.2
            letters = [chr(ord(c) + 0xFEE0) if wide and c.isalnum() else rng.choice([c, c.upper()]) for c in word]
            spelled.append("".join(c + (rng.choice(["", "", " ", "-", "_", "/", ".", " . "]) if c.isalnum() or wide else "") for c in letters))
            keys.append(word)
    assert column(spark, spelled, lambda c: T.match_key(T.nfkc(c))) == keys


def test_mentions(spark):
    """Whole words only, whatever the case and the white space between them."""
    rng = random.Random(2)
    rows = [(None, "zebra"), ("", "zebra")]
    for _ in range(300):
        phrase = " ".join(made_words(rng, rng.randint(1, 2), "bdf", "+#"))
        around = rng.choice([("", ""), ("(", "),"), ("x", ""), ("", "7"), ("_", ""), (". ", "!"), ("-", "-")])
        inside = phrase.replace(" ", rng.choice([" ", "  ", "\n", "-"]))
        rows.append((" ".join([*made_words(rng, 3), around[0] + rng.choice([inside, inside.upper()]) + around[1], *made_words(rng, 2)]), phrase))
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string").select("i", T.mentions("t", "p").alias("m")).collect()
    want = [bool(t and re.search(rf"(?<!\w){re.escape(p)}(?!\w)", " ".join(t.lower().split()))) for t, p in rows]
    assert [r.m for r in sorted(found, key=lambda r: r.i)] == want and 50 < sum(want) < 250


def test_tokens(spark):
    """Words with their signs and inner dots; marks around them are no part."""
    rng = random.Random(3)
    texts, wanted = [], []
    for _ in range(60):
        tokens = [".".join(made_words(rng, rng.randint(1, 3), "bdfé9", "+#")) for _ in range(rng.randint(0, 8))]
        texts.append("".join(rng.choice([" ", "  ", " (", ", ", ". "]) + rng.choice([t, t.upper()]) for t in tokens) + rng.choice(["", ".", " !", ")"]))
        wanted.append(tokens)
    assert column(spark, texts, T.tokens) == wanted


def test_skill_lists(spark):
    """A list literal, text with separators and a group in brackets name the same skills; a skill counts once."""
    rng = random.Random(4)
    values, wanted = [], []
    for _ in range(40):
        names = list(dict.fromkeys(made_words(rng, rng.randint(2, 6))))
        again = [*names, rng.choice(names).upper()]
        values += [repr(again), rng.choice([",", ";", "\n", " , "]).join(again), f"{made_words(rng, 1)[0]} ({', '.join(again)})", f"{names[0]} ({names[-1]})"]
        wanted += [names, names, names, [f"{names[0]} ({names[-1]})"]]
    values += [None, "", "[1, 2]", "q" * 101, "q" * 100, "[open, end", '["k, m", "r"]', '["k", "none"]']
    wanted += [[], [], [], [], ["q" * 100], ["[open", "end"], ["k, m", "r"], ["k"]]
    assert column(spark, values, T.parse_skill_list) == wanted


def test_skills_given_as_lists(spark):
    rows = spark.createDataFrame([(["p, q", " R ", "r", ""],), (None,)], "s array<string>")
    assert [r.x for r in rows.select(T.skill_items("s", "array<string>").alias("x")).collect()] == [["p, q", "R"], []]


def test_experience(spark):
    values = ["7 năm", "5 tháng", "30 months", "No experience", "2 Yrs", "some", "-4", "false", None, "12", "9 yearsago"]
    assert column(spark, values, T.parse_experience) == [7, 0, 2, 0, 2, None, None, None, None, 12, None]


def test_clean(spark):
    assert column(spark, ["  a \n b ", "N/A", "none", "", None, "ﬁne"], T.clean) == ["a b", None, None, None, None, "fine"]


def test_sentences(spark):
    got = column(spark, ["Knows Node.js. Uses ASP.NET! Really? Yes; ok"], T.sentences)
    assert got == [["Knows Node.js.", "Uses ASP.NET!", "Really?", "Yes;", "ok"]]


def test_numbers(spark):
    got = column(spark, ["2,460", "9.876.543", "0,25", "1,2.3", "12,34"], lambda c: F.transform(T.number_readings(c), lambda r: r["value"].cast("double")))
    assert got == [[2460.0, 2.46], [9876543.0], [0.25], [], [12.34]]


def test_markup(spark):
    assert column(spark, ["<!-- x\ny --> a &amp; b "], T.markup_to_text) == ["a & b"]


def test_chunk_sizes():
    words = " ".join(f"w{i}" for i in range(95))
    assert [len(w.split()) for w in D.pack_sentences(words, 40, 0)] == [40, 40, 15]


def test_chunks_overlap_whole_sentences():
    windows = D.pack_sentences("a b c. d e. f g h. i j.", 5, 2)
    assert windows[0] == "a b c. d e." and windows[1].startswith("d e.") and windows[-1].endswith("i j.")
    assert all(len(w.split()) <= 7 for w in windows)


def test_chunker_keeps_header_and_short_documents(spark):
    long = "Title: x" + D.DESCRIPTION + " ".join(f"s{i}." for i in range(50))
    got = column(spark, [long, "plain text"], D.chunks(max_words=20, overlap=5, max_chunks=2))
    assert len(got[0]) == 2 and all(c.startswith("Title: x" + D.DESCRIPTION) for c in got[0]) and got[1] == ["plain text"]


def test_phrases_named_in_a_text(spark):
    phrases = ["python", "c++", "node.js", "go", "big data", "", "straße"]
    texts = ["Python, C++", "c+ + and Node.JS!", "gopher GO", "big  data", None, "STRASSE"]
    rows = spark.createDataFrame([(i, t, phrases) for i, t in enumerate(texts)], "id int, t string, p array<string>")
    folded = F.transform("p", lambda x: T.casefold(x))
    each = rows.select("id", "t", F.explode(folded).alias("p")).where(T.mentions("t", "p")).collect()
    got = {(r.id, p) for r in rows.select("id", T.named_among("t", folded).alias("n")).collect() for p in r.n}
    assert got == {(r.id, r.p) for r in each} and {(0, "c++"), (1, "node.js"), (2, "go"), (3, "big data"), (5, "strasse")} <= got
