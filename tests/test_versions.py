"""Stored records: what isn't of its type is left out, what can't be used is refused."""

from leafmill.operators import versions


def read(spark, reader, *bodies):
    return {r.id: r for r in reader(spark.createDataFrame(list(enumerate(bodies)), "id long, body string")).collect()}


def test_tickets(spark):
    got = read(
        spark, versions.tickets, '{"key":"k","batches":[{"id":"a","pageIndexes":[1,2.0,2.5,"3",null],"collected":true},{"id":""},{"id":4},7,null]}', '{"key":"k","batches":[]}', '{"key":1,"batches":[{"id":"a"}]}',
        '["key"]', "not json", None, '{"key":"k","batches":{"id":"a"}}', '{"key":"","batches":[{"id":"a"}],"termCorrections":[{"from":"x","to":"y"},{"from":1,"to":"y"}],"pageCount":2.0,"complete":"true"}',
    )
    assert set(got) == {0, 7}
    assert [(b.id, b.pages, b.collected) for b in got[0].batches] == [("a", [1, 2], True)] and got[0].file_name == "a book" and got[0].page_count == 0
    assert got[7].key == "" and [tuple(c) for c in got[7].corrections] == [("x", "y")] and got[7].page_count == 2 and not got[7].complete


def test_checkpoints_are_whole_or_refused(spark):
    one = '{"version":1,"key":"k","bodyKey":"b","mode":"notes","proposals":[%s],"facts":[],"failures":[%s]}'
    good = '{"blockId":"b1","kind":"place","text":"t"}'
    got = read(
        spark, versions.checkpoints, one % (good, ""), one % (good + "," + good.replace("place", "places"), ""), one % (good, "3"), (one % ("", "")).replace('"version":1', '"version":2'), (one % ("", "")).replace('"facts":[]', '"facts":3'),
        (one % ("", "")).replace('"notes"', '"both"'), one % ("", '{"chunkIndex":2}'), "{}",
    )
    assert set(got) == {0, 6} and got[0].proposals[0].block_id == "b1" and got[0].proposals[0].reason == "" and tuple(got[6].failures[0]) == (2, "")


def test_runs_and_looks(spark):
    body = '{"facts":[{"id":"f","title":"t","footing":"stated","tags":["a",1],"sourcePage":"2"},{"id":"f","title":"","footing":"stated"},{"id":"g","title":"t","footing":"sure"},4],"adjudicated":{"s1":{"verdict":"v"},"s2":{"verdict":1},"s3":2}}'
    facts = versions.run_facts(spark.createDataFrame([(1, body), (2, '{"facts":{}}'), (3, None)], "id long, body string")).collect()
    assert [(r.id, r.fact_id, r.tags, r.source_page, r.verified) for r in facts] == [(1, "f", ["a"], None, False)]
    verdicts = versions.run_verdicts(spark.createDataFrame([(1, body), (2, '{"adjudicated":[]}'), (3, "")], "id long, body string")).collect()
    assert [tuple(r) for r in verdicts] == [(1, "s1", "v", "", "")]
    looks = read(spark, versions.saved_looks, '{"id":"x","imprint":{"publicDomainNotice":false,"imprint":"I"}}', '{"id":""}', '{"id":"y","imprint":[]}')
    assert set(looks) == {0, 2} and not looks[0].public_domain and looks[0].imprint == "I" and looks[2].public_domain


def test_introductions(spark):
    got = read(spark, versions.introductions, '{"title":" T ","paragraphs":[" a ","",3,"b"]}', '{"paragraphs":["a"]}', '{"paragraphs":[" "]}', '{"paragraphs":"a"}', "[]")
    assert (got[0].title, got[0].text) == ("T", "a\n\nb") and got[1].title == "Introduction"
    assert got[2].refused.endswith("came back empty") and got[3].refused == got[4].refused and got[3].text is None


def test_commands(spark):
    got = read(
        spark, versions.commands, '{"op":"state"}', '{"op":"answer","id":"q","value":true}', '{"op":"answer","id":"q","value":{"a":"b"}}', '{"op":"answer","id":"q","value":["a",1]}', '{"op":"answer","id":"q"}', '{"op":"answer","id":"","value":""}',
        '{"op":"answer","id":"q","value":null}', '{"op":7}', "{}", '"state"', '{"op":"answer","id":"q","value":[]}', '{"op":"evidence","ref":""}',
    )
    assert [k for k, r in got.items() if r.reason is None] == [0, 1, 2, 10] and got[1].value == "true" and got[2].value == '{"a":"b"}' and got[10].value == "[]"
    assert got[7].reason == "Unknown command “7”." and got[8].reason == "Unknown command “undefined”." and got[9].reason == "A command must be an object."
