import random
import re
import time

from tabloom.llm import queries
from tabloom.llm.quotes import link_quotes


def naive(rows):
    """(conv, turn) -> (n_quotes, n_linked, quoted_turn, reply_to, root, depth), one conversation's messages after the
    other, each quoted passage compared with everything said before."""
    said, out = {}, {}
    turns = {(c, t) for c, t, _ in rows}
    parsed = {}
    for c, t, text in rows:
        runs = []
        for raw in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)+", raw)
            low = raw[marks.end() if marks else 0 :]
            low = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(x.lower() if "A" <= x <= "Z" else x for x in low)).strip(" ")
            if not low:
                continue
            level = marks.group().count(">") if marks else 0
            if runs and runs[-1][0] == level:
                runs[-1][1].append(low)
            else:
                runs.append((level, [low]))
        parsed[c, t] = runs
        for level, lines in runs:
            if level == 0:
                for piece in {" ".join(lines), *lines}:
                    said[c, piece] = min(said.get((c, piece), t), t)
    up = {}
    for (c, t), runs in parsed.items():
        linked, sizes = 0, {}
        for level, lines in runs:
            found = {p: said[c, p] for p in {" ".join(lines), *lines} if level and said.get((c, p), t) < t}
            linked += bool(found)
            for p, origin in found.items():
                sizes.setdefault((level, origin), {})[p] = len(p)
        best = min(((level, -sum(ps.values()), -o) for (level, o), ps in sizes.items()), default=None)
        up[c, t] = -best[2] if best else None
        out[c, t] = (sum(level > 0 for level, _ in runs), linked)
    for c, t in parsed:
        root, depth = t, 0
        while up[c, root] is not None:
            root, depth = up[c, root], depth + 1
        before = t - 1 if (c, t - 1) in turns else None
        out[c, t] += (up[c, t], up[c, t] if up[c, t] is not None else before, root, depth)
    return out


def got(df):
    return {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.quoted_turn, r.reply_to, r.root, r.depth) for r in link_quotes(df).collect()}


def test_against_naive_reader(spark):
    rng = random.Random(4)
    vocabulary = ["Yes", "no", "see you  at NINE", "the long line of words", "ok", "", "fine\twith me"]
    rows = []
    for c in range(6):
        for t in range(25):
            lines = [rng.choice(["", "", ">", "> ", ">>", " > > "]) + rng.choice(vocabulary) + rng.choice(["", f" {rng.randrange(4)}"]) for _ in range(rng.randrange(6))]
            rows.append((c, t if t < 20 else t + 3, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    assert got(df) == naive(rows)


def test_query_against_naive_reader(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got(df) == naive([(r.conv_id, r.turn, r.text) for r in df.collect()])


def test_long_message_and_clashing_names(spark):
    """40,000 lines of changing level take linear time; columns with the names of results play no part."""
    long = "\n".join(("> " if i % 2 else "") + f"line {i // 2}" for i in range(40_000))
    names = ["n_quotes", "n_linked", "quoted_turn", "content", "reply_to", "depth", "level", "hash", "size", "origin", "n"]
    df = spark.createDataFrame([(1, 0, "user", "line 5", *names), (1, 1, "user", long, *names)], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names))
    began = time.time()
    assert got(df)[1, 1][:3] == (20_000, 1, 0)
    assert time.time() - began < 60


def test_links(spark):
    first, second = "Shall we meet at noon?\nOr later.", "Noon is  FINE"
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", "Unrelated remark"),
        (1, 2, "assistant", "> shall we meet at noon?\n> or later.\nNoon is fine"),
        (1, 3, "user", ">> Or later.\n> " + second + "\nGood"),
        (1, 4, "user", "> never said\nHm"),
        (1, 5, "user", ">good\n>\n>  Noon is fine\nBoth"),
        (2, 7, "user", "> Good\nOther conversation"),
        (2, 9, None, None),
        (None, 1, "user", "> Good"),
        (3, None, "user", ""),
        (2, 7, "user", "> Good\nOther conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    show = lambda c, t: (got[c, t].n_quotes, got[c, t].n_linked, got[c, t].quoted_turn, got[c, t].reply_to, got[c, t].root, got[c, t].depth)
    assert show(1, 0) == (0, 0, None, None, 0, 0)
    assert show(1, 1) == (0, 0, None, 0, 1, 0)
    assert show(1, 2) == (1, 1, 0, 0, 0, 1)
    assert show(1, 3) == (2, 2, 2, 2, 0, 2)
    assert show(1, 4) == (1, 0, None, 3, 4, 0)
    assert show(1, 5) == (1, 1, 2, 2, 0, 2)  # the longer of both
    assert show(2, 7) == (1, 0, None, None, 7, 0)
    assert show(None, 1)[3:] == (None, None, 0)
    assert got[1, 2].content == "Noon is fine" and got[2, 9].content == ""
    assert link_quotes(df).count() == len(rows)
    order = [r.turn for r in link_quotes(df.where("conv_id = 1").coalesce(1)).collect()]
    assert order == [0, 2, 3, 5, 1, 4]


def test_turn_after_an_empty_one(spark):
    texts = ["Hello", None, "after null", "", "after empty", " \t", "after space", "> \n>>", "after marks"]
    rows = [(1, i, "user", x) for i, x in enumerate(texts)] + [(2, 0, "user", None), (2, 2, "user", "after a gap")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth) for r in link_quotes(df).collect()}
    assert got == {(1, i): (i - 1 if i else None, i, 0) for i in range(len(texts))} | {(2, 0): (None, 0, 0), (2, 2): (None, 2, 0)}


def test_long_chain(spark):
    rows = [(1, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, root int")
    got = sorted((r.turn, r.root, r.depth) for r in link_quotes(df).collect())
    assert got == [(i, 0, i) for i in range(40)]


def test_empty(spark):
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_keeps_rows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert queries.op8_quotes(spark, sf_dir).count() == n
