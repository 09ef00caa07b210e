"""Mixing and chat formatting: SQL, plain brute force and edge cases."""

import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import duck, same

from quillgraph.llm import chat, mixing, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), duck(SF), registry.ORACLE_SQL[name])


def water_fill(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), dict.fromkeys(names, 0)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
        left, free = left - sum(target[s] for s in over), free - over
    return target


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "", "x"), (2, None, None)],
        [(1, "a b c", "x"), (2, None, None), (None, "a", "y"), (3, "a b c d e f g", "z"), (3, "a b c d e f g", "z"), (4, "w " * 400, None)],
        [(i, "w " * (i % 50), f"s{i * i % 7}") for i in range(900)] + [(i, "v " * 40, "hot") for i in range(1000, 1600)],
    ],
)
def test_mix_meets_targets(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]], taken[r["source"]] = r["source_size"], taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = water_fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.01, abs=3)


#: Words of a text, by its id.
LENGTHS = {"4": "4", "2 to 15": "2 + id % 14", "mostly empty": "if(id % 5 = 0, 13, 0)", "few long ones": "if(id % 4096 = 0, 20000, 2)"}


@pytest.mark.parametrize("length", LENGTHS)
def test_mix_of_short_texts_meets_targets(spark, length):
    """The smallest source has over 2048 * 512 words, so blocks are of 2048 words."""
    mean = {"4": 4, "2 to 15": 8.5, "mostly empty": 2.6, "few long ones": 6.8}[length]
    docs = None
    for k, words in enumerate((3_700_000, 2_200_000, 1_100_000)):
        part = spark.range(int(words / mean)).selectExpr(f"id * 3 + {k} AS doc_id", f"repeat('w ', cast({LENGTHS[length]} AS int)) AS text", f"'s{k}' AS source")
        docs = part if docs is None else docs.unionByName(part)
    rows = mixing.mix(docs).selectExpr("*", "taken <= 3 * size AS fits").groupBy("source", "source_size").agg({"taken": "sum", "fits": "min"}).collect()
    target = water_fill({r["source"]: r["source_size"] for r in rows})
    assert min(r["source_size"] for r in rows) >= 2048 * 512 and target["s2"] == 3 * min(r["source_size"] for r in rows)
    for r in rows:
        assert r["min(fits)"]
        assert r["sum(taken)"] == pytest.approx(target[r["source"]], rel=0.01)


def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([0.0, rng.random() * 10 ** rng.randrange(4)]), 37 * g) for g in range(1, 6) for i in range(1 + 4 * g)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], "seats", "w", ["i"]).collect()
    for g in range(1, 6):
        quotients = sorted(((-w / (2 * k + 1), i) for gg, i, w, n in rows if gg == g and w for k in range(n)))[: 37 * g]
        want = {i: sum(x == i for _, x in quotients) for gg, i, _, _ in rows if gg == g}
        assert {r["i"]: r["quota"] for r in got if r["g"] == g} == want


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 40)) + " ", f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(df).collect()}
    words = {}
    for r in mixing.mixed_documents(df).collect():
        words.setdefault(r["doc_id"], []).extend(r["text"].split())
    for i, (size, n) in taken.items():
        assert len(words.get(i, [])) == n
        assert set(words.get(i, [])) <= {f"w{i}_{k}" for k in range(size)}
    # words of a document are taken evenly: whole rounds and one cut
    for w in words.values():
        counts = {x: w.count(x) for x in set(w)}
        assert max(counts.values(), default=0) <= 3


def test_mixed_documents_tell_repeated_ids_apart(spark):
    """Rows of one id and size get the parts that the mix gives them, each its own."""
    rows = [(i // 8, " ".join(f"w{i}_{k}" for k in range(20)), f"s{i // 8 % 3}") for i in range(240)] + [(None, f"n{i} m{i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    taken, words = {}, {}
    for r in mixing.mix(df).collect():
        taken.setdefault(r["doc_id"], []).append(r["taken"])
    first, again = (sorted(map(tuple, mixing.mixed_documents(x).collect()), key=str) for x in (df, df.repartition(5)))
    assert first == again
    for _, text, _ in first:
        for w in text.split():
            of = w.split("_")[0].replace("m", "n")
            words[of] = words.get(of, 0) + 1
    got = {}
    for i, (doc, _, _) in enumerate(rows):
        got.setdefault(doc, []).append(words.get(f"w{i}" if i < 240 else f"n{i - 240}", 0))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}


TURNS = "conv_id long, turn long, role string, text string, extra string, formatted string"


def conversations():
    rng = random.Random(9)
    rows = []
    for c in range(40):
        roles = (["system"] if c % 3 == 0 else []) + [rng.choice(["user", "assistant"]) for _ in range(rng.randrange(0, 30))]
        for k, role in enumerate(roles):
            rows.append((c, k, role, " ".join(rng.choice(["word", "<|im_end|>", "<\\|", "é", "\n", "<<|im_start|>user"]) for _ in range(rng.randrange(0, 120))), "x", "y"))
    rows += [(100, 0, "system", "alone", None, None), (101, None, None, None, None, None), (101, 0, "a%0A\nb<|", "t", None, None), (None, 0, "assistant", "n", None, None), (102, 0, "assistant", "w " * 5000, None, None), (103, 0, "user", "same", None, None), (103, 0, "user", "same", None, None)]
    return rows


@pytest.mark.parametrize("budget", [512, 60])
def test_chat_reads_back(spark, budget):
    rows = conversations()
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget, budget // 4)
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        # markers stand only where the template put them
        assert w["formatted"].count("<|im_start|>") == w["formatted"].count("<|im_end|>") == len(re.findall(r"<\|", w["formatted"])) / 2
        assert len(w["turns"]) <= w["formatted"].count("<|im_start|>")
        own = [t for t in w["turns"] if not t["repeated"]]
        again = sum(len(w["formatted"][t["start"] : t["start"] + t["length"]].split()) for t in w["turns"] if t["repeated"])
        assert own and again <= budget // 4 + 1 + 2 * len(w["turns"])
        head = [r for r in rows if r[0] == w["conv_id"]][0]
        if head[2] == "system":
            assert w["formatted"].startswith("<|im_start|>system\n")


def test_chat_of_nothing(spark):
    assert chat.digests(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("budget", [512, 60])
def test_chat_windows_keep_the_budget(spark, budget):
    """A window is over the budget only if a single turn doesn't fit beside the system turn; history keeps its own."""
    history = budget // 4
    tokens = lambda piece: len(re.findall(r"[^\x20\x09-\x0D]+", chat_text(piece))) + 4

    def chat_text(piece):
        return re.sub(r"<\\\\(\\\\*)\|", r"<\1|", piece[len("<|im_start|>") : -len("<|im_end|>\n")].split("\n", 1)[1])

    rows = conversations() + [(200, k, "user" if k % 2 else "assistant", "w " * (k * 37 % 300)) for k in range(400)] + [(201, 0, "system", "s " * 300)] + [(201, k, "user", "w " * (k * 53 % 200)) for k in range(1, 90)]
    df = spark.createDataFrame([(*r[:4], None, None) if len(r) == 4 else r for r in rows], TURNS)
    heads = {r[0]: r for r in rows if r[1] == 0 and r[2] == "system"}
    over = 0
    for w in chat.format_windows(df, budget, history).collect():
        pieces = [(t, w["formatted"][t["start"] : t["start"] + t["length"]]) for t in w["turns"]]
        head = heads.get(w["conv_id"])
        head_tokens = len((head[3] or "").split()) + 4 if head else 0
        rest = [(t, p) for t, p in pieces if not (head and t["pos"] == 1)]
        own, again = [tokens(p) for t, p in rest if not t["repeated"]], [tokens(p) for t, p in rest if t["repeated"]]
        if head_tokens + sum(own) + sum(again) > budget:
            over += 1
            assert len(own) == 1 and not again and head_tokens + own[0] > budget
        assert sum(again) <= history
    assert over or budget == 512


def test_a_hot_conversation_is_formatted(spark):
    turns = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('w ', int(id % 90)) AS text")
    got = chat.digests(chat.format_windows(turns)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(7, 20_000)]
    assert got[0]["loss_chars"] == sum(2 * (k % 90) for k in range(1, 20_000, 2))


def test_mix_of_short_texts_matches_sql(spark, tmp_path):
    """Shards of many short texts, some with few blocks, and sources at their limit."""
    docs = None
    for k, (n, words) in enumerate(((9000, "2 + id % 14"), (4000, "4"), (3000, "if(id % 900 = 0, 3000, 3)"))):
        part = spark.range(n).selectExpr(f"id * 3 + {k} AS doc_id", f"repeat('w ', cast({words} AS int)) AS text", f"'s{k}' AS source")
        docs = part if docs is None else docs.unionByName(part)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(mixing.op1_mix_sources(spark, str(tmp_path)), con, mixing.OP1_SQL) == 16_000
