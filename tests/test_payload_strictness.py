"""Bodies that are not one whole JSON value are rejects."""

from deskline.operators import commands as C


def test_text_behind_a_value_is_a_reject(spark):
    bodies = [(1, '{"my_ticket":[{"id":2}]}'), (2, '{"my_ticket":[{"id":2}]} trailing'), (3, '{"my_ticket":[{"id":2}'), (4, None), (5, '{"my_ticket":[]}')]
    ok, bad = C.unwrap_envelope(spark.createDataFrame(bodies, "event_id bigint, body string"))
    assert [(r["event_id"], r["id"]) for r in ok.collect()] == [(1, 2)]
    assert sorted(r["event_id"] for r in bad.collect()) == [2, 3, 4]
    one = '{"attachments":[{"contentType":"application/pdf","contentUrl":"u"}]}'
    got = C.valid_uploads(spark.createDataFrame([(1, one), (2, one + " x"), (3, None)], "event_id bigint, payload string"))
    assert sorted((r["event_id"], r["n_attachments"], r["ok"], r["content_url"]) for r in got.collect()) == [
        (1, 1, True, "u"), (2, 0, False, None), (3, 0, False, None)]


def test_a_bad_item_leaves_its_neighbours(spark):
    bodies = [(1, '{"my_ticket":[{"id":2,"x":[{}],"createDate":"2024-01-02T03:04:05Z"},7,{"id":"abc"},{"id":1.5},{"title":"t"},null,"{}",{"id":3}]}'),
              (2, '{"my_ticket":[{"id":2}]} x'), (3, '{"my_ticket":5}'), (4, None), (5, '{"my_ticket":[]}'), (6, "[]"), (7, ""), (8, '{"my_ticket":null}')]
    ok, bad = C.unwrap_items(spark.createDataFrame(bodies, "event_id bigint, body string"))
    got = ok.collect()
    assert sorted((r["event_id"], r["pos"], r["id"]) for r in got) == [(1, 0, 2), (1, 7, 3)]
    assert {r["id"]: r["createDate"] and r["createDate"].year for r in got} == {2: 2024, 3: None}
    told = {(r["event_id"], r["pos"]): (r["reason"], r["record"]) for r in bad.collect()}
    assert {k: v[0] for k, v in told.items()} == {
        (1, 1): "object", (1, 2): "fields", (1, 3): "fields", (1, 4): "id", (1, 5): "object", (1, 6): "object",
        (2, None): "body", (3, None): "list", (4, None): "body", (6, None): "list", (7, None): "body", (8, None): "list"}
    assert told[1, 2][1] == '{"id":"abc"}' and told[2, None][1] == bodies[1][1] and told[1, 5][1] == "null"
    assert all(f.isEmpty() for f in C.unwrap_items(spark.createDataFrame([], "event_id bigint, body string")))
