"""Small zstd archives."""

import json
from pathlib import Path

import zstandard

JAN06, FEB06 = 1136073600, 1138752000


def write(root, name, rows, window_log=None, frames=1):
    at = Path(root, "comments" if name.startswith("RC") else "submissions", f"{name}.zst")
    at.parent.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window_log or 0, write_checksum=True, write_content_size=window_log is None)
    step = -(-len(lines) // frames) or 1
    data = b""
    for k in range(0, max(len(lines), 1), step):
        part = "".join(x + "\n" for x in lines[k : k + step]).encode()
        if window_log:
            c = zstandard.ZstdCompressor(compression_params=params).compressobj()
            data += c.compress(part) + c.flush()
        else:
            data += zstandard.ZstdCompressor(compression_params=params).compress(part)
    at.write_bytes(data)
    return at


def comment(i, author="alice", subreddit="programming", body="hello", score=1, created=JAN06, parent="t3_s1", **more):
    return {"id": i, "author": author, "subreddit": subreddit, "body": body, "score": score, "created_utc": created, "parent_id": parent, "link_id": "t3_s1", "distinguished": None} | more


def submission(i, author="bob", subreddit="programming", title="a title", selftext="", score=5, created=JAN06, url="https://example.com/x", domain="example.com", is_self=False, **more):
    return {"id": i, "author": author, "subreddit": subreddit, "title": title, "selftext": selftext, "score": score, "created_utc": created, "url": url, "domain": domain, "is_self": is_self} | more


def basic(root):
    write(root, "RS_2006-01", [submission("s1"), submission("s2", author="AutoModerator", domain="nytimes.com", title="News")])
    write(root, "RC_2006-01", [comment("c1"), comment("c2", author="charlie", parent="t1_c1", body="see http://x.org", score=7), comment("c3", author="[deleted]", body="gone")])
    write(root, "RC_2006-02", [comment("c4", created=FEB06, author=" alice ", subreddit="Rust", score=-3), comment("c5", created=FEB06 + 5, author="Dora", body="Straße ÜBER")], frames=2)
    return root
