import hashlib
import random

from pyspark.sql import functions as F

from seriesmith.llm import chat as C
from seriesmith.llm.queries import op10_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string"


def hostile(n, seed=1):
    rng = random.Random(seed)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "$1", "é", "😀", "<\\s>", "[\\\\/INST]", "", "\r"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in hostile(800)], "t string")
    got = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in got)
    assert all(c not in r["e"] for r in got for c in ("<s>", "</s>", "[INST]", "[/INST]", "<SYS>"))


def conversations():
    texts = hostile(120, 2)
    rows = [(i // 4, i % 4, ["user", "assistant", "system", "to\nol %0A"][(i + i // 4) % 4], t) for i, t in enumerate(texts)]
    rows += [(100, 0, "user", "hi"), (100, 1, "assistant", "ho"), (101, 0, "system", "s"), (101, 1, "user", "u"), (101, 2, "assistant", "a")]
    rows += [(102, None, None, None), (102, 1, "assistant", None), (None, 0, "user", "x"), (103, 1, "assistant", "b"), (103, 1, "assistant", "b"), (103, 0, "assistant", "a" * 300_000)]
    return rows


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}


def test_round_trip(table):
    rows = conversations()
    got = C.format_chats(C.conversations_as_records(table(rows, SCHEMA)))
    got = got.select("*", C.parse(F.col("formatted")).alias("back"), C.loss_spans(F.col("formatted")).alias("spans")).collect()
    want = expected(rows)
    assert {r["conv_id"] for r in got} == set(want)
    layouts = {r["conv_id"]: r["layout"] for r in got}
    assert layouts[100] == "prompt" and layouts[101] == "instruction_input" and layouts[103] == "messages"
    for r in got:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["back"]] == [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert [t["loss"] for t in r["back"]] == [role == "assistant" for role, _ in turns]
        masked = [r["formatted"][s["start"] : s["end"]] for s in r["spans"]]
        assert len(masked) == sum(role == "assistant" for role, _ in turns)
        for part, (_, text) in zip(masked, [t for t in turns if t[0] == "assistant"], strict=True):
            assert part.replace("\\", "") == text.replace("\\", "")


def test_layouts(spark):
    schema = "id long, prompt string, completion string, instruction string, input string, output string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"
    m = [("user", "q"), ("assistant", "a")]
    rows = [
        (1, "q", "a", None, None, None, None, None, None), (2, "q", None, None, None, None, None, None, None), (3, None, None, "q", None, "a", None, None, None), (4, None, None, "s", "q", "a", None, None, None),
        (5, None, None, None, None, None, None, m, None), (6, None, None, None, None, None, None, None, [("human", "q")]), (7, None, None, None, None, None, "s", m, None), (8, None, None, None, None, None, None, None, None),
        (9, "q", None, "q", None, None, None, None, None), (10, None, None, None, None, None, None, [], None),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("layout", F.lit("clash"))
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in C.canonical_turns(df, [c for c in df.columns if c not in ("id", "layout")]).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got[1] == ("prompt", qa) and got[2] == ("prompt_only", qa[:1]) and got[3] == ("instruction", qa) and got[4] == ("instruction_input", [("system", "s"), *qa])
    assert got[5] == ("messages", qa) and got[6] == ("shares", [("human", "q")]) and got[7] == ("system_messages", [("system", "s"), *qa]) and got[8] == got[10] == ("nothing", [])
    assert got[9] == (None, None), "unknown layouts keep their row"


def test_fingerprints_are_the_engines(spark):
    for m in C.MAPPINGS:
        assert spark.range(1).select(F.xxhash64(F.lit(" ".join(sorted(m.paths))))).first()[0] == m.fingerprint()
    assert len({m.fingerprint() for m in C.MAPPINGS}) == len(C.MAPPINGS)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in op10_chat_formatting(spark, sf).collect()}
    want = expected(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(want)
    for c, turns in want.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] >= sum(len(b) for _, b in turns)


def test_empty(table):
    assert C.format_chats(C.conversations_as_records(table([], SCHEMA))).count() == 0
