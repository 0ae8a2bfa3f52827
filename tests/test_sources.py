"""Schemas, paged tables and other readers."""

import copy
import json

import pytest

from tempora.sources import schema

LABEL = {
    "schema_version": "1.1.0", "clip_id": "B01-AB_CD", "take_id": "t", "baseline_id": "B01", "genre": None, "who": {"speaker_id": "s", "gender": None, "synthetic_voice": False},
    "where": {"base_condition": "C0", "added_condition": None, "params": {}}, "duration_s": 3.5, "seed": 4.0, "labels_from": "human", "multi_set": ["a"],
    "what": [{"flaw": "FADE", "category": "Volume", "start_s": 0, "end_s": 1.5, "word_start": 0, "word_end": 2, "level": 5, "confidence": 1}],
    "scores": {"overall": 100, "band": "strong", "categories": {"Pacing": 0}}, "more": 1,
}


def changed(path, value):
    doc = copy.deepcopy(LABEL)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


def test_every_rule_of_the_label_schema_is_told_with_its_path(spark):
    cases = [
        ("[1]", "<root>", "[1] is not of type 'object'"), ("{bad", "<root>", "not a JSON document"), (changed(["schema_version"], "1.0"), "schema_version", "'1.1.0' was expected"),
        (changed(["clip_id"], 5), "clip_id", "5 is not of type 'string'"), (changed(["clip_id"], "b1"), "clip_id", None), (changed(["baseline_id"], "B1"), "baseline_id", "'B1' does not match '^B[0-9]{2}$'"),
        (changed(["genre"], 1), "genre", "1 is not of type 'string', 'null'"), (changed(["who"], "x"), "who", "'x' is not of type 'object'"), (changed(["who", "speaker_id"], KeyError), "who", "'speaker_id' is a required property"),
        (changed(["who", "gender"], "Q"), "who/gender", "'Q' is not one of ['F', 'M', 'X', None]"), (changed(["who", "synthetic_voice"], None), "who/synthetic_voice", "None is not of type 'boolean'"),
        (changed(["where", "added_condition"], "N30"), "where/added_condition", None), (changed(["where", "params"], []), "where/params", "[] is not of type 'object'"),
        (changed(["what"], {}), "what", "{} is not of type 'array'"), (changed(["what", 0], True), "what/0", "True is not of type 'object'"), (changed(["what", 0, "flaw"], "LOUD"), "what/0/flaw", None),
        (changed(["what", 0, "level"], 2.5), "what/0/level", "2.5 is not of type 'integer'"), (changed(["what", 0, "level"], 0), "what/0/level", "0 is less than the minimum of 1"),
        (changed(["what", 0, "level"], 6), "what/0/level", "6 is greater than the maximum of 5"), (changed(["what", 0, "end_s"], "1"), "what/0/end_s", "'1' is not of type 'number'"),
        (changed(["what", 0, "end_s"], KeyError), "what/0", "'end_s' is a required property"), (changed(["what", 0, "confidence"], 1.01), "what/0/confidence", "1.01 is greater than the maximum of 1"),
        (changed(["duration_s"], 0), "duration_s", "0 is less than or equal to the minimum of 0"), (changed(["duration_s"], True), "duration_s", "True is not of type 'number'"), (changed(["seed"], 1.5), "seed", "1.5 is not of type 'integer'"),
        (changed(["labels_from"], KeyError), "<root>", "'labels_from' is a required property"), (changed(["multi_set"], ["a", 3]), "multi_set/1", "3 is not of type 'string'"),
        (changed(["scores", "band"], "good"), "scores/band", None), (changed(["scores", "categories", "Pacing"], 101), "scores/categories/Pacing", "101 is greater than the maximum of 100"),
    ]
    good = [json.dumps(LABEL), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *[c[0] for c in cases]])], "path int, value string")
    rows = docs.select("path", schema.problems(docs["value"], schema.LABEL_SCHEMA).alias("found")).collect()
    got = {r.path: r.found for r in rows}
    assert got[0] == [] and got[1] is None
    for i, (_, path, message) in enumerate(cases, len(good)):
        assert [p.path for p in got[i]] == [path], (cases[i - len(good)], got[i])
        assert message is None or got[i][0].message == message
    told = schema.breaches(docs.withColumnRenamed("path", "id"), schema.LABEL_SCHEMA).collect()
    assert len(told) == len(cases) and told[0].asDict().keys() == {"id", "path", "message"}
    assert schema.require_valid(docs.filter("path < 2"), schema.LABEL_SCHEMA).count() == 2
    with pytest.raises(ValueError, match="who/gender: 'Q'"):
        schema.require_valid(docs.filter(f"path = {len(good) + 9}"), schema.LABEL_SCHEMA)


def test_words_of_schemas(spark):
    def told(rules, *values):
        df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, value string")
        return [[p.message for p in r.found] for r in df.select("i", schema.problems(df["value"], rules).alias("found")).orderBy("i").collect()]

    assert told({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [], [1], [1, 1], [1, 2, 3], "x") == [["[] is too short"], [], ["[1,1] has non-unique elements"], ["[1,2,3] is too long"], []]
    assert told({"minLength": 2, "maxLength": 3, "pattern": "b"}, "b", "bé", "bbbb", "aa", 5) == [["'b' is too short"], [], ["'bbbb' is too long"], ["'aa' does not match 'b'"], []]
    assert told({"exclusiveMaximum": 5, "multipleOf": 0.5}, 4.5, 5, 4.3, -7) == [[], ["5 is greater than or equal to the maximum of 5"], ["4.3 is not a multiple of 0.5"], []]
    assert told({"enum": [1, "1", True, [1, 2]]}, 1.0, "1", True, [1, 2], 2, None)[:4] == [[]] * 4
    assert told({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1}, {"b": 1, "c": 2}) == [[], ["Additional properties are not allowed ('b', 'c' were unexpected)"]]
    assert told({"anyOf": [{"type": "string"}, {"minimum": 3}]}, "x", 4, 1) == [[], [], ["1 is not valid under any of the given schemas"]]
    assert told({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, 4, 0) == [[], ["4 is valid under more than one of the given schemas"], ["0 is not valid under any of the given schemas"]]
    assert told({"not": {"type": "null"}, "allOf": [True, {"type": ["number", "null"]}]}, None, 1, "x") == [['None should not be valid under {"type": "null"}'], [], ["'x' is not of type 'number', 'null'"]]
    assert told(False, 1) == [["False schema does not allow 1"]]
    with pytest.raises(ValueError, match="leads back"):
        schema.problems(spark.range(1)["id"].cast("string"), {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}})
    with pytest.raises(ValueError, match="contains"):
        schema.problems(spark.range(1)["id"].cast("string"), {"contains": {}})


@pytest.fixture
def service():
    """A service of 230 rows, a third of whose answers fail at first and one of which stays broken."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    asked: list[int] = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = parse_qs(urlparse(self.path).query)
            offset, length = int(q["offset"][0]), int(q["length"][0])
            asked.append(offset)
            again = asked.count(offset) > 1
            if self.path.startswith("/broken") and offset == 60 or offset % 3 == 0 and not again:
                self.send_error(503)
                return
            rows = [{"row_idx": i, "row": {"text": f"row {i}", "n": i * 2, "more": None}} for i in range(offset, offset + length)]
            rows = rows[1:] if offset == 40 and not again else rows  # a row short at first
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": rows}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_pages_are_asked_again_and_pruned(spark, service):
    from tempora.sources import paged

    url, asked = service
    read = lambda path, **more: paged.paged_rows(spark, url + path + "?offset={offset}&length={length}", "row_idx long, text string, n int, absent string", 230, page_size=20, pause_s=0.01, **more)
    rows = read("/rows", pages_per_task=3).collect()
    assert sorted((r.row_idx, r.text, r.n, r.absent) for r in rows) == [(i, f"row {i}", 2 * i, None) for i in range(230)]
    assert asked.count(0) == 2 and asked.count(40) == 2 and asked.count(20) == 1 and read("/rows", pages_per_task=3).rdd.getNumPartitions() == 4
    asked.clear()
    few = read("/rows", pages_per_task=1).filter("row_idx > 99 and row_idx <= 125 and n % 4 = 0")
    assert sorted(r.row_idx for r in few.collect()) == list(range(100, 126, 2)) and set(asked) == {100, 120}
    assert read("/rows").filter("row_idx = 7").collect()[0].text == "row 7" and read("/rows").filter("row_idx < 0").count() == 0
    with pytest.raises(Exception, match="no page at .*offset=60"):
        read("/broken", tries=2).collect()
