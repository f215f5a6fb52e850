import hashlib
import random
from collections import defaultdict

import duckdb
from paperloom.llm import chat_format as cf


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def conversations():
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<\\|", "\\\\<|", "<", "|", "\n", "<\\N", "é", "🙂", "word ", "long " * 30, "<|", "x\\"]
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (2, 0, "user", ""), (3, None, "assistant", "no turn"), (3, 0, None, "no role"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (4, 5, "user", "same"), (5, 0, "a\nb<|\\", "odd role"), (6, 0, "system", "s" * 9000), (6, 1, "assistant", "z" * 20000), (6, 2, "assistant", "end")]
    for c in range(10, 25):
        for t in range(rng.choice([2, 9, 120])):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))))
    return rows


def test_reads_back_what_was_said(spark):
    rows = conversations()
    docs = spark.createDataFrame([(*r, "q", "q") for r in rows], "conv_id long, turn long, role string, text string, window string, body string").repartition(5)
    out = {r.conv_id: r for r in cf.digests(docs).collect()}
    said = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said[c].append((role or "", text or ""))
    assert set(out) == set(said)
    for c, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        got = out[c]
        assert got.n_turns == len(turns) and got.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got.loss_chars == len(loss) and got.loss_sha256 == sha(loss)
    windows = cf.windows(docs).collect()
    for w in windows:
        pieces = w.formatted.split("<|im_end|>\n")
        assert all(p.startswith("<|im_start|>") for p in pieces[:-1]) and pieces[-1] == "" and w.formatted.count("<|") == 2 * (len(pieces) - 1)
        assert len(w.formatted) <= cf.CHARS * cf.BUDGET or len(pieces) - 1 - w.repeated == 1 or any(len(p) > cf.CHARS * cf.BUDGET // 4 for p in pieces)
        assert w.repeated <= cf.HISTORY_TURNS + 1
        for s in w.loss:
            assert w.formatted[: s.start].endswith("<|im_start|>assistant\n") and w.formatted[s.start + s.length :].startswith("<|im_end|>")
    assert max(sum(w.conv_id == c for w in windows) for c in said) > 3
    assert all(w.formatted.startswith("<|im_start|>system\n") for w in windows if w.conv_id and w.conv_id >= 10 and w.conv_id % 2)
    assert sum(r.formatted_chars for r in out.values()) == sum(len(w.formatted) for w in windows)


def test_empty(spark):
    assert cf.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    out = cf.op5_chat_format(spark, d)
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(cf.SQL).fetchall())
    assert "Python" not in out._jdf.queryExecution().toString()


def test_very_long_conversation_and_given_tokens(spark):
    """20,000 turns; tokens counted in bytes, so that windows of a script of many bytes keep the budget too."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "日本語のとても長い文" * (t % 4)) for t in range(20_000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = cf.windows(docs, cf.F.ceil(cf.F.octet_length("body") / 3)).cache()
    assert windows.select(cf.F.max(cf.F.octet_length("formatted"))).first()[0] <= 3 * cf.BUDGET
    back = cf.read_back(windows).orderBy("window").collect()
    assert sum(r.n_turns for r in back) == 20_000 and "".join(r.loss_text for r in back) == "".join(t for _, _, r, t in rows if r == "assistant")
