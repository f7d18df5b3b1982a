import pytest

from strandline.functions import strict_json as sj
from strandline.functions.strict_json import ANY, MANIFEST, Rejected, read


@pytest.mark.parametrize("text, value", [("1.0", 1), ("1e3", 1000), ("10e-1", 1), ("100e-2", 1), ("-0.0", 0), ("0e-999999999999", 0), ("1.25e2", 125), ("9007199254740991.0", 9007199254740991), ("90071992547409910e-1", 9007199254740991)])
def test_integers(text, value):
    assert read(text.encode()) == value


@pytest.mark.parametrize("text", ["1.5", "9007199254740991.1", "1e-999", "1e-400", "1e17", "1e999999999999", "NaN", "Infinity", "-Infinity", "[NaN]", "1.00000000000000001", '{"a":1}{}', '{"a":1,"a":2}', '{"a":1,"\\u0061":2}', '"\\ud800"', '"\\udc00\\ud800"', '{"\\ud800":1}', '[{"a":"\\udfff"}]', "", "{", "nul", "[" * 17 + "]" * 17, '"a\nb"'])
def test_rejected(text):
    with pytest.raises(Rejected):
        read(text.encode())


@pytest.mark.parametrize("text, value", [('"\\ud83d\\udcf7"', "📷"), ('"\\\\ud800"', "\\ud800"), ('"e\\u0301"', "e\u0301"), ('"a\\n"', "a\n"), ('"\\ufffd"', "�"), (" [1] \n", [1])])
def test_accepted(text, value):
    assert read(text.encode()) == value


def frame(**more):
    import json

    base = {"frame_id": "x", "request_wall_ms": 1, "sha256": "h", "byte_length": 2} | more
    return json.dumps({"frames": [base]}).encode()


def test_shapes():
    assert read(frame(session_id=None), MANIFEST) == read(frame(), MANIFEST)
    for bad in (frame(other=1), frame(frame_id=None), frame(byte_length="2"), frame(byte_length=True), b'{"frames":{}}', b"{}", b'{"Frames":[]}', b"\xff"):
        with pytest.raises(Rejected):
            read(bad, MANIFEST)
    with pytest.raises(Rejected):
        read(b'"' + b"a" * sj.MAX_JSON + b'"', ANY)


def test_verdicts(spark):
    df = spark.createDataFrame([(1, '{"a":1.0,"b":null}'), (2, '{"a":1}{}'), (3, None)], "id long, ok string")
    got = {r.id: r for r in sj.verdicts(df.withColumnRenamed("ok", "raw"), "raw").collect()}
    assert (got[1].ok, got[1].document) == (True, '{"a":1}') and (got[2].ok, got[2].reason) == (False, "trailing data") and got[3].ok is False


def test_requests_and_manifests(spark, tmp_path):
    from strandline.sources import readers

    (tmp_path / "a.json").write_bytes(frame(request_wall_ms=5))
    (tmp_path / "b.json").write_bytes(b"{")
    got = readers.manifests(readers.requests(spark, f"file://{tmp_path}")).collect()
    assert len(got) == 1 and got[0].frames[0].request_wall_ms == 5
