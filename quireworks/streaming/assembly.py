"""Documents out of pages that arrive in any order.

A document's pages wait in its state until the last one is there or its deadline has passed in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "idx array<int>, infos array<string>, texts array<string>, deadline long"
_OUT = "doc_id {kind}, complete boolean, document string, markdown string"


def _document(idx: list[int], infos: list[str], texts: list[str | None], version: str) -> tuple[str, str]:
    order = sorted(range(len(idx)), key=idx.__getitem__)
    body = ",".join(infos[i] for i in order)
    return f'{{"pdf_info":[{body}],"_backend":"vlm","_version_name":"{version}"}}', "\n\n".join(texts[i] for i in order if texts[i])


def documents(pages: DataFrame, wait: str = "30 minutes", late: str = "10 minutes", version: str = "1.0.0") -> DataFrame:
    """(doc_id, complete, document, markdown) of a stream of pages (doc_id, page_idx, pages, ts, info, markdown), as
    assemble.documents makes them of a table.

    A document comes out once its `pages` pages are there, or, not complete, when the watermark (`late` behind
    the latest ts) is `wait` past the first ts that was seen of it. Of a page that comes twice the first counts. Pages
    that come after their document make one of their own, which is never complete. Rows without a number of a page
    or of pages are left out; a null ts can't move a deadline, so such rows are, too.
    """
    rows = pages.where("page_idx IS NOT NULL AND pages IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    info = F.to_json(F.struct(*(F.col(f"info.{n}") for n in ("para_blocks", "discarded_blocks", "page_size")), "page_idx"))
    seconds = f"CAST((timestamp'1970-01-01 00:00:00' + INTERVAL {wait}) AS DOUBLE) - CAST(timestamp'1970-01-01 00:00:00' AS DOUBLE)"
    due = (F.unix_millis("ts") + (F.expr(seconds) * 1000).cast("long")).alias("due")
    slim = rows.select("doc_id", "ts", "page_idx", "pages", due, info.alias("info"), "markdown")

    def grown(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, infos, texts, deadline = map(lambda x: list(x) if hasattr(x, "__len__") else x, state.get) if state.exists else ([], [], [], 0)

        def out(complete: bool) -> pd.DataFrame:
            state.remove()
            return pd.DataFrame([(key[0], complete, *_document(idx, infos, texts, version))], columns=["doc_id", "complete", "document", "markdown"])

        if state.hasTimedOut:
            yield out(False)
            return
        total = 0
        for batch in batches:
            for i, n, due, info, text in batch[["page_idx", "pages", "due", "info", "markdown"]].itertuples(index=False):
                total = max(total, int(n))
                deadline = min(deadline or int(due), int(due))
                if int(i) not in idx:
                    idx.append(int(i))
                    infos.append(info)
                    texts.append(text)
        if len(idx) >= total:
            yield out(True)
        else:
            state.update((idx, infos, texts, deadline))
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))

    kind = dict(pages.dtypes)["doc_id"]
    return slim.groupBy("doc_id").applyInPandasWithState(grown, _OUT.format(kind=kind), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
