"""Which page a company's workers fetch next, as a stateful stream.

Events (company, kind, page, n_rows, at) come from the workers:

    start     a run of the company begins; ``page`` is its number of pages (null: not known)
    ask       a worker is free
    done      a page is fetched and ``n_rows`` new rows of it are saved (0: it had rows, but none was new; null: no rows)
    failed    a page couldn't be fetched
    stop      no more pages are wanted

The state of a company is its done and assigned pages, the rows saved, and why it stopped.  An ``ask`` is answered with the
smallest page that is neither done nor assigned.  A failed page stays assigned, so it is not dealt again in the run; the
next ``start`` frees it.  No page is dealt beyond the total, once ``cap`` rows are saved, or after ``streak`` pages in a row
whose rows were all known.  Companies are the stream's keys: they are independent and spread over all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .marks import CAP

EVENTS = "company string, kind string, page int, n_rows long, at long"
#: Fixed value: pages in a row without a new row after which a company is left.
STREAK = 3
DEALT = "company string, at long, page int, reason string"


class Desk:
    """A company's pages."""

    def __init__(self, state: dict | None = None):
        self.done, self.assigned, self.total, self.saved, self.streak, self.reason = set(), set(), None, 0, 0, None
        if state:
            self.__dict__ |= state | {"done": set(state["done"]), "assigned": set(state["assigned"])}

    def state(self) -> dict:
        return self.__dict__ | {"done": sorted(self.done), "assigned": sorted(self.assigned)}

    def next(self, cap: int) -> tuple[int | None, str | None]:
        """The next page, or why there is none."""
        if self.reason is None and self.saved >= cap:
            self.reason = "cap"
        if self.reason is not None:
            return None, self.reason
        page = 1
        while page in self.done or page in self.assigned:
            page += 1
        if self.total is not None and page > self.total:
            return None, "no page left"
        self.assigned.add(page)
        return page, None

    def hear(self, kind: str, page: int | None, n_rows: int | None, streak: int) -> None:
        if kind == "start":
            self.assigned, self.streak, self.reason, self.total = set(), 0, None, page
        elif kind == "done" and page is not None:
            self.assigned.discard(page)
            if page not in self.done:
                self.done.add(page)
                self.saved += n_rows or 0
                self.streak = self.streak + 1 if n_rows == 0 else 0
                if self.streak >= streak:
                    self.reason = self.reason or "nothing new"
        elif kind == "stop":
            self.reason = self.reason or "stopped"


def dispatched(events: DataFrame, cap: int = CAP, streak: int = STREAK) -> DataFrame:
    """The answers (company, at, page, reason) to the asks among the ``events``, a stream; page is null with a reason.

    Within a batch a company's events go by ``at``; ties: start, done, failed, stop, then asks.
    """
    rank = {"start": 0, "done": 1, "failed": 2, "stop": 3, "ask": 4}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        desk = Desk(json.loads(state.get[0]) if state.exists else None)
        heard = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: (r.at, rank.get(r.kind, 9), -1 if pd.isna(r.page) else r.page))
        out = []
        for r in heard:
            if r.kind == "ask":
                out.append((key[0], r.at, *desk.next(cap)))
            else:
                desk.hear(r.kind, None if pd.isna(r.page) else int(r.page), None if pd.isna(r.n_rows) else int(r.n_rows), streak)
        state.update((json.dumps(desk.state()),))
        yield pd.DataFrame(out, columns=["company", "at", "page", "reason"]).astype({"page": "Int32"})

    return events.groupBy("company").applyInPandasWithState(run, DEALT, "desk string", "append", GroupStateTimeout.NoTimeout)
