import json
import math
import random

import duckdb

from foliospark.llm.chat import SQL, format_chats, with_parts

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    result = {}
    for conv in {r[0] for r in rows}:
        prompt, attachments, tokens, n = "", [], 0, 0
        turns = [r[1:] for r in rows if r[0] == conv]
        for _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "user", t[2] or "")):
            n, text = n + 1, text or ""
            parts = [{"type": "text", "text": text}]
            if text.startswith("["):
                try:
                    found = json.loads(text)
                    if found and all(isinstance(p, dict) and p.get("type") in ("text", "image", "audio", "document") for p in found):
                        parts = found
                except ValueError:
                    pass
            prompt += f"<|{role or 'user'}|>\n"
            for p in parts:
                size = lambda k, p=p: max(0, p.get(k) or 0)
                if p["type"] == "text":
                    prompt += p.get("text") or ""
                    tokens += len((p.get("text") or "").split())
                    continue
                cost = {"image": max(1, math.ceil(size("width") / 28) * math.ceil(size("height") / 28)), "audio": math.ceil(size("seconds")) * 25, "document": max(1, math.ceil(size("pages"))) * 256}[p["type"]]
                attachments.append({"index": len(attachments) + 1, "type": p["type"], "ref": p.get("url") or "", "tokens": cost})
                prompt += f"<|{p['type']}_{len(attachments)}|>"
                tokens += cost
            prompt += "<|end|>\n"
        result[conv] = (prompt, n, tokens, len(attachments), attachments)
    return result


def test_against_brute_force(spark):
    rng = random.Random(2)

    def part():
        kind = rng.choice(["text", "image", "audio", "document"])
        return {"type": kind} | rng.choice([{"text": "a b  c"}, {"url": "s3://x/1.png", "width": rng.randrange(2000), "height": 300.5}, {"seconds": 3.2, "url": "u"}, {"pages": 4}, {}])

    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            text = rng.choice(["plain text", json.dumps([part() for _ in range(rng.randrange(1, 5))]), "[not json", '[{"type":"text","text":"hi"}] trailing words', '[{"type":"text"}][]', '[{"type": "video"}]', "[]", None, "", "x " * 20_000 if conv == 3 else "y"])
            rows.append((conv, rng.choice([turn, None, 0]), rng.choice(["user", "assistant", None]), text))
    rows += [(None, 0, "user", "n"), rows[0]]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA + ", n_turns int, prompt string")
    got = {r.conv_id: (r.prompt, r.n_turns, r.expanded_tokens, r.n_attachments, json.loads(r.attachments)) for r in format_chats(frame).collect()}
    assert got == brute(rows)
    assert format_chats(frame.limit(0)).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert {tuple(r) for r in format_chats(with_parts(spark.read.parquet(f"{sf}/conversations.parquet"))).collect()} == set(con.sql(SQL).fetchall())


def test_many_parts_and_rows_without_a_conversation(spark):
    parts = [{"type": "image", "url": f"u{i}", "width": 28, "height": 28} if i % 2 else {"type": "text", "text": f"t{i} "} for i in range(4000)]
    rows = [(1, 0, "user", json.dumps(parts)), (None, 0, "user", "a"), (None, 1, None, "b")]
    got = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.prompt for r in got if r.conv_id is None) == ["<|user|>\na<|end|>\n", "<|user|>\nb<|end|>\n"]
    (one,) = [r for r in got if r.conv_id == 1]
    assert (one.prompt, one.n_attachments, one.expanded_tokens) == (brute(rows[:1])[1][0], 2000, 4000)
