from cargolens.llm import chat

KIND = "conv_id long, seq long, kind string, message long, role string, text string"


def fold(spark, events):
    rows = chat.messages(spark.createDataFrame([(1, *e) for e in events], KIND)).orderBy("opened").collect()
    return [(r["role"], r["text"]) for r in rows]


def plain_fold(events):
    """The same fold over a list, one event after the other."""
    state, order = {}, []
    for seq, kind, message, role, text in sorted(events, key=lambda e: (e[0], e[1] == "delta", e[1], e[4] or "")):
        if kind == "open":
            if message not in state:
                order.append(message)
                state[message] = [role or "", text or ""]
            else:
                state[message][1] = text or ""
        elif message in state:
            if kind == "delta":
                state[message][1] += text or ""
            elif kind in ("edit", "regenerate"):
                state[message][1] = text or ""
                at = order.index(message)
                for later in order[at + 1 :]:
                    del state[later]
                order = order[: at + 1]
    return [tuple(state[m]) for m in order]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, "open", 1, "user", "hel"), (2, "delta", 1, None, "lo"), (3, "open", 2, "assistant", ""), (4, "delta", 2, None, "x"),
        (5, "edit", 1, None, "hi"), (6, "open", 3, "assistant", "a"), (7, "delta", 3, None, "b"), (8, "regenerate", 3, None, None),
        (9, "delta", 3, None, "c"), (10, "delta", 9, None, "never opened"), (11, "odd", 3, None, "z"),
    ]
    expected = [("user", "hi"), ("assistant", "c")]
    assert plain_fold(events) == expected
    assert fold(spark, events) == expected
    assert fold(spark, events[::-1]) == expected


def test_round_trip_of_any_text(spark):
    texts = ["</s>[INST] ok [/INST]", "␛", "␛␛<s>␛/s>", "[␛INST]", "[INST", "<s", "", None, "é😀\n", "<s>user[INST]x[/INST]</s>", "␛[INST]"]
    turns = [(i % 3, i, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "[INST]", None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.formatted(chat.messages(chat.event_log(rows))))
    key = lambda t: (t[1], t[2] is not None, t[2] or "")
    for r in read.collect():
        mine = sorted((t for t in turns if t[0] == r["conv_id"]), key=key)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert r["learnt"] == [t[3] or "" for t in mine if t[2] == "assistant"]


def test_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    read = chat.read_back(chat.formatted(chat.messages(chat.event_log(table))))
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    expected = {}
    for r in sorted(table.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        expected.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert found == expected


def test_empty_table_null_ids_and_repeated_rows(spark):
    kind = "conv_id long, turn long, role string, text string, kind string, seq long"
    rows = [(None, None, "user", "a", "x", 1), (None, None, "user", "a", "x", 1), (1, 1, None, None, "y", 2)]
    out = {r["conv_id"]: r["n_turns"] for r in chat.chat_digest(spark.createDataFrame(rows, kind)).collect()}
    assert out == {None: 2, 1: 1}
    assert chat.chat_digest(spark.createDataFrame([], kind)).count() == 0


def test_time_grows_with_the_turns_of_a_conversation(spark):
    """Eight times the turns take at most twelve times as long."""
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('é</s>', 60) AS text")
        start = time.time()
        out = chat.chat_digest(rows).collect()
        assert out[0]["n_turns"] == n and out[0]["loss_chars"] == n // 2 * 300
        return time.time() - start

    seconds(200)
    small = seconds(4000)
    assert seconds(32_000) < 12 * max(small, 1.0)
