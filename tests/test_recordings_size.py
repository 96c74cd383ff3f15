"""Recorded answers are written compressed, and read as they were."""

import json
from pathlib import Path

from railside.sources import order_books
from tests.oracle import SMALL, differences


def test_answers_are_compressed_and_read_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(order_books, "scratch", lambda spark, name: str(tmp_path / name))
    from railside import registry

    assert differences(order_books.order_books(spark, SMALL), SMALL, registry.ORACLES["src_order_book"]) == []
    files = [f.name for f in Path(tmp_path).rglob("part-*")]
    assert files and all(f.endswith(".gz") for f in files)


def _line(*markets, **more):
    return json.dumps({"jsonrpc": "2.0", "result": list(markets), "id": 1, **more})


def _market(key, *runners, **more):
    return {"marketId": key, "runners": [{"selectionId": s, "ex": {"availableToBack": [{"price": p, "size": 1}], "availableToLay": None}} for s, p in runners], **more}


ODD = ["no envelope", "[1]", "{}{}", '{"a":', "1}", '{"result":[{"marketId":5}]}', '{"result":[{"marketId":"n","event":null}]}', '{"result":[{"marketId":"a","marketId":"b"}]}', '{"result":[{"runners":[{"selectionId":1.0}]}],}', '{"result":[1]}', '{"error":{"message":"m"}}']
PLAIN = [_line(_market("m1", (1, 2.0), (2, 3))), _line(_market("m1", (None, 4.5), (1, 9), status="OPEN", inplay=True), _market(None, (1, 5.0))), _line({"marketId": "m1", "marketName": "W", "event": {"venue": "V"}, "runners": [{"selectionId": 1, "runnerName": "A"}, {"selectionId": 1, "runnerName": "B"}]}, {"marketId": None, "marketName": "W", "runners": [{"selectionId": 1, "runnerName": "C"}]}), _line()]


def test_blocks_read_at_once_tell_what_lines_tell(tmp_path):
    for n, lines in enumerate([PLAIN, ODD, *[[*PLAIN, x] for x in ODD], [x.replace("A", "É") for x in PLAIN]]):
        path = str(tmp_path / f"{n}.json")
        Path(path).write_text("\n\n".join(lines) + "\n")
        one, all_ = list(order_books.envelopes(path, str(tmp_path))), [r for b in order_books.states(path, str(tmp_path)) for r in b.to_pylist()]
        assert [(r["file"], r["line"], r["kind"], r["error"]) for r in all_] == [(f, i, k, e) for f, i, k, _, e in one]
        plain = [r["state"] is not None for r in all_]
        assert plain == [lines[0] is PLAIN[0] and len(lines) == len(PLAIN) or "É" in "".join(lines)] * len(plain)
        for r, (_, _, _, market, _) in zip(all_, one, strict=True):
            if r["state"]:
                assert r["state"]["marketId"] == json.loads(market)["marketId"] and [x["selectionId"] for x in r["state"]["runners"]] == [x["selectionId"] for x in json.loads(market)["runners"]]


def test_recordings_are_read_once_and_not_joined(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(PLAIN))
    (tmp_path / "b.json").write_text("\n".join(["no envelope", _line(_market("m2", (7, 1.5)))]))
    frames = [order_books.runner_books(order_books.read_recordings(spark, str(tmp_path), states=s)) for s in (True, False)]
    plain, texts = [sorted(map(tuple, f.collect()), key=repr) for f in frames]
    assert plain == texts
    rows = {(r.market_id, r.selection_id, r.back, r.lay, r.venue, r.name, r.inplay) for r in frames[0].collect()}
    assert rows == {("m1", None, 4.5, None, None, None, True), ("m1", 1, 9.0, None, "V", "A", True), ("m1", 1, 9.0, None, "V", "B", True), (None, 1, 5.0, None, None, None, None), ("m2", 7, 1.5, None, None, None, None)}
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and "Join" not in plan
