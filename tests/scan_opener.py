"""An opener of saved answers that tasks import by name."""

import io
import json
import urllib.parse


def saved(url, headers):
    query = urllib.parse.parse_qs(urllib.parse.urlsplit(url).query)
    titles = query["titles"][0].split("|")
    half = len(titles) // 2
    more = "from" in query
    shown = titles[half:] if more else titles[:half]
    answer = {"answers": {t: {"license": f"L{t}"} for t in shown if t != "gone"}}
    return io.BytesIO(json.dumps(answer | ({} if more or not half else {"continue": {"from": "x"}})).encode())
