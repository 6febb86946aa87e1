"""Hydration predicates against plain loops over the rows, and the filters of a reset."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodestone.operators import hydration as H

NOW = "2024-03-02T00:00:00Z"


def fixture(seed=2):
    rng = random.Random(seed)
    urls = lambda: [{"expanded_url": rng.choice(["https://a", "https://b", "", None])} for _ in range(rng.randint(0, 3))] + [{}]
    posts = lambda: rng.choice([None, "", "{bad", "[]", json.dumps({"snapshot": {"media_objects": [{"type": "photo"}]}}), json.dumps({"snapshot": {"media_objects": [{}]}}), json.dumps({"quoted_status_result": 1, "tweetResult": {}}), json.dumps({"raw": {"data": {"tweetResult": {"result": {"note_tweet": {"note_tweet_results": {"result": {"entity_set": {"urls": urls()}}}}}}}}})])
    items = [(i, rng.choice(["x_quote", "x_bookmark", None]), rng.choice(["", "error", "ok_graphql", "ok_web", "gone", None]), posts(), rng.choice([None, "[]", "{bad", '["https://a"]']), "clash") for i in range(300)]
    assets = [(a, rng.choice(["", "pending", "error", "downloaded", "gone"]), rng.randint(0, 4), rng.choice(["", "2024-02-29T00:00:00Z", "2024-03-01T00:00:00Z", "2024-03-01T00:00:01Z"]), rng.choice(["video", "photo", "animated_gif"]), rng.choice(["", "/x.jpg", "/x.webp", "/x.mp4"]), rng.choice(["", "https://pbs.twimg.com/x", "https://video/"])) for a in range(60)]
    links = [(rng.randint(0, 299), rng.randint(0, 70)) for _ in range(250)]
    quotes = [(rng.randint(0, 299), rng.choice(["quoted_post", "reply"])) for _ in range(150)]
    return items, links, assets, quotes


def plainly(items, links, assets, quotes):
    by_id = {a[0]: a for a in assets}
    due = (datetime.fromisoformat(NOW.replace("Z", "+00:00")) - timedelta(hours=24)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def parsed(text):
        try:
            return json.loads(text or "")
        except ValueError:
            return None

    out = {}
    for item, source_type, status, post, have, _ in items:
        source_type, status, post, doc = source_type or "", status or "", post or "", parsed(post)
        mine = [by_id.get(a) for i, a in links if i == item]
        media = False
        if isinstance(doc, dict) and (doc.get("snapshot") or {}).get("media_objects", [{}])[0].get("type") is not None:
            again = any(a and (a[1] in ("", "pending") or a[1] == "error" and a[2] < 3 and (a[3] == "" or a[3] <= due)) for a in mine)
            still = any(a and a[1] == "downloaded" and a[4] in ("video", "animated_gif") and (a[5].endswith((".jpg", ".jpeg", ".png", ".webp")) or a[6].startswith("https://pbs.twimg.com/")) for a in mine)
            media = not mine or again or still
        quote = any(m in post for m in H.QUOTE_MARKS) and (item, "quoted_post") not in quotes
        direct = source_type == "x_quote" and status == "ok_graphql" and '"tweetResult"' not in post
        note = False
        if isinstance(doc, dict) and "raw" in doc:
            urls = doc["raw"]["data"]["tweetResult"]["result"]["note_tweet"]["note_tweet_results"]["result"]["entity_set"]["urls"]
            note = any(u.get("expanded_url") and u["expanded_url"] not in (parsed(have) or []) for u in urls)
        candidate = status in ("", "api_error", "error", "rate_limited") or status.startswith("ok_") and (media or quote or direct or note)
        out[item] = (media, quote, direct, note, candidate)
    return out


def test_hydration(spark, tmp_path):
    items, links, assets, quotes = fixture()
    frames = {
        "items": spark.createDataFrame(items, "item long, source_type string, status string, post string, links string, kind string"),
        "links": spark.createDataFrame(links, "item long, asset long"),
        "assets": spark.createDataFrame(assets, "asset long, status string, errors int, last_attempt string, kind string, path string, url string"),
        "quotes": spark.createDataFrame(quotes, "item long, kind string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}")
    found = H.hydration(*(spark.read.parquet(f"{tmp_path}/{n}") for n in frames), NOW)
    got = {r["item"]: (r.media_repair, r.quote_repair, r.direct_repair, r.note_repair, r.candidate) for r in found.collect()}
    assert got == plainly(items, links, assets, quotes)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") in (4, 8)  # each table once, before and after adaptive planning
    none = [df.limit(0) for df in frames.values()]
    assert H.hydration(*none, NOW).count() == 0


def test_reset_filter(spark):
    rows = [(1, "www.A.example", "web", "error", "", "timeout", 3), (2, "a.example", "pdf", "ok", "error", "", 0), (3, "x.a.example", "web", "error", "", "dns", 1), (4, "ba.example", "web", "", "", "", 9)]
    df = spark.createDataFrame(rows, "id long, domain string, source_type string, extract_status string, summary_status string, failure_kind string, failures int")
    found = lambda **by: [r.id for r in df.where(H.reset_filter(**by)).orderBy("id").select("id").collect()]
    assert found(domains=[" WWW.a.example", "a.example", ""]) == [1, 2, 3]
    assert found(ids=[0, -1, 2, 2, 4]) == [2, 4]
    assert found(types=["WEB "], extract=["error"], least_failures=2) == [1]
    assert found(kinds=["dns", "timeout"], domains=["x.a.example"]) == [3]
    assert found(summary=["error"]) == [2]
    assert H.reset_filter() is None and H.reset_filter(domains=["www."], ids=[-4]) is None
    assert df.where(F.lit(True)).count() == 4
