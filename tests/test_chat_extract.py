"""Transcripts (multi-level assembly), last message, reply parsing and prompts."""

from newsloom.operators import chat, extract


def test_transcripts_multi_level_equals_python(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"m{t}") for t in range(11)] + [(2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: (r.transcript, r.n_turns) for r in chat.transcripts(df, turns_per_chunk=3).collect()}
    expect = "\n".join(f"{'assistant' if t % 2 else 'user'}: m{t}" for t in range(11))
    assert out[1] == (expect, 11)
    assert out[2] == ("user: s", 1)
    last = {r.conv_id: r for r in chat.last_message(df).collect()}
    assert last[1].last_turn == 10 and last[1].next_step == "end"


def test_parse_responses_statuses(spark):
    rows = [(1, "no json"), (2, "{}"), (3, '```json\n{"models":[{"id":"m","name":"Flux Capacitor X","version":"1"}]}\n```'),
            (4, '{"models":[{"id":"m","name":"N"}]}'), (5, '{"runs":[{"id":"r","name":"R"}],"relationships":[]}')]
    df = spark.createDataFrame(rows, "doc_id long, response string")
    got = {r.doc_id: (r.status, r.n_runs) for r in extract.parse_responses(df).collect()}
    assert got == {1: ("junk", 0), 2: ("valid", 0), 3: ("rejected", 0), 4: ("invalid", 0), 5: ("valid", 1)}
    valid, review = extract.route(extract.parse_responses(df))
    assert valid.count() == 2 and review.count() == 3


def test_prompts_keep_whole_text(spark):
    text = "x" * 50000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    p = df.select(extract.extraction_prompt("text").alias("p")).first().p
    assert text in p


def test_long_conversation_spans_many_chunks(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"line {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    out = chat.transcripts(df).first()
    assert out.n_turns == 3000
    assert out.transcript == "\n".join(f"{'user' if t % 3 else 'assistant'}: line {t}" for t in range(3000))


def test_reply_sizes_do_not_depend_on_ansi_mode(spark):
    df = spark.createDataFrame([(1, "junk"), (2, "{}")], "doc_id long, response string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            got = {r.doc_id: (r.n_models, r.n_runs) for r in extract.parse_responses(df).collect()}
            assert got == {1: (0, 0), 2: (0, 0)}, mode
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


MODEL = '"id":"m","name":"N","version":"1"'
TYPED = [
    ('{"models":[{' + MODEL + '}]}', "valid"), ('{"models":[{"id":5,"name":"N","version":"1"}]}', "invalid"),
    ('{"models":[{"id":"m","name":true,"version":"1"}]}', "invalid"), ('{"models":[{' + MODEL + ',"description":null}]}', "valid"),
    ('{"models":[{' + MODEL + ',"description":4}]}', "invalid"), ('{"models":[{' + MODEL + ',"created_at":"2024-01-05T10:00:00Z"}]}', "valid"),
    ('{"models":[{' + MODEL + '}]} trailing', "junk"), ('{"models":[]}{"models":[]}', "junk"), ('{"models":[]},{"models":[]}', "junk"),
    ('{"models":[]}],[{}', "junk"), ('```json\n{"models":[]}\n``` more', "junk"), ('[{"models":[]}]', "invalid"), ("5", "invalid"), ("", "junk"),
    ('{"models":[5]}', "invalid"), ('{"models":{}}', "invalid"), ('{"models":null}', "invalid"), ('{"runs":[{"id":"r","name":"R","status":7}]}', "invalid"),
    ('{"runs":[{"id":"r","name":"R","status":null}]}', "invalid"), ('{"runs":[{"id":"r","name":"R","metrics":{"a":[1]}}]}', "invalid"),
    ('{"relationships":[{"source_id":"a","target_id":"b","type":"T","properties":"x"}]}', "invalid"),
    ('{"models":[{"id":"m","name":"flux capacitor","name":"N","version":"1"}]}', "valid"),      # the last of a repeated key counts
    ('{"models":[{"id":"m","name":"N","name":"Flux Capacitor","version":"1"}]}', "rejected"),
    ('{"models":[{"id":"m","name":"newsloom:end-of-reply","version":"1"}]}', "junk"),
]


def test_replies_are_checked_by_type(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(TYPED)], "doc_id long, response string")
    got = {r.doc_id: r.status for r in extract.parse_responses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TYPED)}


def test_values_survive_however_they_are_written(spark):
    deployment = '{"deployments":[{"id":"d","name":"D","image":"i","replicas":%s}]}'
    rows = [(i, deployment % v) for i, v in enumerate(['3', '"3"', '2.0', '" +4 "', 'true', '"two"', '2.5', 'null', '"2.5"', '1e2', '"99999999999999999999"'])]
    df = extract.parse_responses(spark.createDataFrame(rows, "doc_id long, response string"))
    got = {r.doc_id: (r.status, r.deployments[0].replicas) for r in df.collect()}
    assert [got[i][1] for i in range(5)] == [3, 3, 2, 4, 1] and got[9] == ("valid", 100)
    assert {got[i][0] for i in range(5)} == {"valid"} and {got[i][0] for i in (5, 6, 7, 8, 10)} == {"invalid"}
    run = '{"runs":[{"id":"r","name":"R","metrics":{"a":"0.9","b":1,"c":true},"parameters":{"lr":0.001,"x":{"y":[1]},"n":null}}]}'
    r = extract.parse_responses(spark.createDataFrame([(1, run)], "doc_id long, response string")).first().runs[0]
    assert r.metrics == {"a": 0.9, "b": 1.0, "c": 1.0} and r.parameters == {"lr": "0.001", "x": '{"y":[1]}', "n": None}


def test_a_reply_is_parsed_once(spark):
    df = extract.parse_responses(spark.createDataFrame([(1, "{}")], "doc_id long, response string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("tryparsejson") + plan.lower().count("parsejson(") + plan.lower().count("parse_json(") <= 1 and "from_json" not in plan
