"""Changes of citations with a busy query and model on one day, cut into blocks, against a plain search."""

import datetime as dt
import random

from siteglass.operators import answers as A

SCHEMA = "query string, model string, observed_at timestamp, mentioned boolean, citations array<struct<url:string>>, citations_status string"


def rows(draw, n, seconds):
    start = dt.datetime(2024, 5, 1)
    return [
        ("q", draw.choice("ab"), start + dt.timedelta(seconds=draw.randrange(seconds)), draw.random() < 0.5, [{"url": u} for u in sorted(draw.sample("uvwxyz", 2))], "ok")
        for _ in range(n)
    ]


def plain(previous, current):
    out = []
    for q, m, at, mentioned, urls, status in current:
        earlier = [r for r in previous if r[:2] == (q, m) and r[2] < at]
        if not earlier:
            out.append((m, at, False, None, 0, 0))
            continue
        last = max(earlier, key=lambda r: r[2])
        new, old = {u["url"] for u in urls}, {u["url"] for u in last[4]}
        mention = "unchanged" if last[3] == mentioned else "added" if mentioned else "lost"
        out.append((m, at, True, mention, len(new - old), len(old - new)))
    return sorted(out, key=str)


def test_a_busy_key_of_one_day_is_cut_into_blocks(spark):
    draw = random.Random(2)
    # Stored records have times of their own, so the latest one is unique; current ones may share a time.
    previous = list({(r[1], r[2]): r for r in rows(draw, 500, 80_000)}.values())
    current = rows(draw, 300, 80_000)
    frames = [spark.createDataFrame(x, SCHEMA) for x in (previous, current)]
    want = plain(previous, current)
    for one_block, blocks in ((A.ONE_BLOCK, A.BLOCKS), (50, 7), (0, 64)):
        got = A.citation_diff(*frames, one_block=one_block, blocks=blocks).selectExpr(
            "model", "observed_at", "has_previous", "mention", "size(citations_added)", "size(citations_lost)"
        )
        assert sorted(map(tuple, got.collect()), key=str) == want
