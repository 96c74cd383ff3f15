"""Recorded answers in batch and as a stream; page states of any shape."""

import json
from datetime import date

from railside.sources.order_books import Recordings, _Reader, read_recordings, runner_books, stream_recordings
from railside.sources.racecards import card_runners, histories


def _write(folder, name, *envelopes):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in envelopes) + "\n\n")


def _book(market, back, last=None, **more):
    ex = {"availableToBack": [{"price": back, "size": 1}], "availableToLay": [{"price": back + 1, "size": 1}], "tradedVolume": []} if back else None
    return {"marketId": market, "status": "OPEN", "runners": [{"selectionId": 1, "status": "ACTIVE", "lastPriceTraded": last, "ex": ex}], **more}


CATALOGUE = {"jsonrpc": "2.0", "id": 1, "result": [{"marketId": "m1", "marketName": "Win", "marketStartTime": "2024-01-05T13:05:00Z", "event": {"venue": "Ascot"}, "runners": [{"selectionId": 1, "runnerName": "Able"}]}]}


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_batch_and_stream_give_the_same_rows(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.json", CATALOGUE, {"result": [_book("m1", 3.0), _book("m2", None, 7.5)]})
    _write(folder, "b.json", {"error": {"code": -32099, "message": "no session"}}, "not json", "[1]", {"result": [_book("m1", 4.0, extra={"x": [1]})]})
    _write(folder, "_hidden.json", CATALOGUE)
    stream, state, out = stream_recordings(spark, str(folder)), str(tmp_path / "state"), str(tmp_path / "out")

    def run():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    assert _rows(run()) == _rows(read_recordings(spark, str(folder)))
    _write(folder, "c.json", {"result": [_book("m2", 9.0)]})
    again = run()  # from the checkpoint: the new file only is read
    assert _rows(again) == _rows(read_recordings(spark, str(folder))) and again.count() == 8
    assert {(r.market_id, r.venue, r.name, r.back, r.lay, r.vwap) for r in runner_books(again).collect()} == {("m1", "Ascot", "Able", 4.0, 5.0, 4.5), ("m2", None, None, 9.0, 10.0, 9.5)}
    errors = {(r.file.rsplit("/", 1)[1], r.line, r.error) for r in again.where("error is not null").collect()}
    assert {(f, n) for f, n, _ in errors} == {("b.json", 1), ("b.json", 2), ("b.json", 3)} and ("b.json", 1, "no session") in errors


def test_a_partition_is_a_file_and_reads_alike_again(tmp_path):
    _write(tmp_path, "a.json", *[{"result": [_book(f"m{i}", 2.0)]} for i in range(3000)])  # more than a block
    _write(tmp_path, "b.json", CATALOGUE)
    reader = Recordings({"path": str(tmp_path)}).reader(None)
    assert isinstance(reader, _Reader)
    parts = reader.partitions()
    assert [p.path.rsplit("/", 1)[1] for p in parts] == ["a.json", "b.json"]
    first = iter(reader.read(parts[0]))
    next(first)  # a task that died
    assert len(list(reader.read(parts[0]))) == 3000 and list(reader.read(parts[0])) == list(reader.read(parts[0]))


def test_an_empty_folder(spark, tmp_path):
    assert read_recordings(spark, str(tmp_path)).collect() == [] and runner_books(read_recordings(spark, str(tmp_path))).collect() == []


def _page(state) -> str:
    return f"<script>\nwindow.PRELOADED_STATE = {state if isinstance(state, str) else json.dumps(state)};\n</script>"


def test_states_of_any_shape(spark):
    pages = [
        ("https://x.test/profile/horse/1/able-one", _page({"profile": {"horseUid": 11, "horseName": "ABLE (IRE)", "age": "Died as a 6-y-o", "horseDateOfBirth": "2015-03-01T00:00", "comments": [{"individualComment": "c"}], "previousTrainers": [{"trainerStyleName": "T", "trainerUid": 5, "trainerChangeDate": "2020-02-03T01:02"}, {"odd": [1, {"y": 2}]}], "previousOwners": None, "medical": {"not": "a list"}}, "quotes": [{"notes": "q", "raceId": 9}], "new": {"deep": [[[]]]}})),
        ("https://x.test/profile/horse/2/baker-two", "<p>no script</p>"),
        ("https://x.test/profile/horse/3/c", _page("{broken")),
        ("https://x.test/profile/horse/4/d", _page({"profile": {"horseUid": "text", "age": 7, "comments": []}, "quotes": []})),
        ("short", None),
    ]
    frame = spark.createDataFrame(pages, "url string, html string")
    rows = {r.url.rsplit("/", 1)[-1]: r for r in card_runners(frame).collect()}
    able = rows["able-one"]
    assert (able.horse_id, able.name, able.age, able.dob, able.comment, able.sire, able.broken) == (11, "Able", 6, date(2015, 3, 1), "c", None, False)
    assert (rows["baker-two"].horse_id, rows["baker-two"].name, rows["baker-two"].broken) == (2, "Baker Two", True)
    assert (rows["c"].broken, rows["d"].broken, rows["d"].age, rows["d"].horse_id, rows["short"].horse_id, rows["short"].name) == (True, False, 7, 4, None, None)
    found = {(r.list, r.pos, r.who, r.who_id, r.what, r.day, r.race_id) for r in histories(frame).collect()}
    assert found == {("trainer", 0, "T", 5, None, date(2020, 2, 3), None), ("trainer", 1, None, None, None, None, None), ("quote", 0, None, None, "q", None, 9)}
    assert histories(frame.limit(0)).collect() == []
