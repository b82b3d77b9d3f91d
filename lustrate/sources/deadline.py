"""Work under a deadline that holds: it is done in a child process, which is ended when time runs out.

A task keeps one child and hands it items, many at a time; only after a deadline (or if the child dies)
another is started. The child notes in shared memory which item it is at and since when, so each item has
a deadline of its own. Work in native code, which no signal handler of Python interrupts, ends too.
"""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable, Iterator


class TimedOut(Exception):
    """The work took longer than it may."""


class Died(Exception):
    """The child ended without an answer, e.g. for lack of memory."""


#: Seconds, and weight of the answers, after which the child sends those that it has; at most so much work
#: is done twice where a later item ends the child.
FLUSH, FLUSH_WEIGHT = 0.25, 1 << 20


def _serve(link, place, work: Callable, weigh: Callable) -> None:
    while True:
        try:
            items = link.recv()
        except EOFError:
            return
        answers, sent, weight = [], time.monotonic(), 0
        for i, item in enumerate(items):
            place[1] = time.monotonic()  # before the number: no item is seen with the time of an earlier one
            place[0] = i
            try:
                answers.append((True, work(*item)))
                weight += weigh(answers[-1][1])
            except BaseException as e:  # noqa: BLE001  it is raised again where the work was asked for
                answers.append((False, e))
            if weight > FLUSH_WEIGHT or time.monotonic() - sent > FLUSH:
                link.send(answers)
                answers, sent, weight = [], time.monotonic(), 0
        if answers:
            link.send(answers)


class Timed:
    """``work`` in a child of this process; ``with`` ends the child. ``weigh`` tells what an answer weighs."""

    def __init__(self, work: Callable, seconds: float, weigh: Callable = lambda answer: 1):
        self.work, self.seconds, self.weigh, self.child = work, seconds, weigh, None
        self.context = multiprocessing.get_context("fork")

    def start(self) -> None:
        self.link, theirs = self.context.Pipe()
        self.place = self.context.RawArray("d", 2)
        self.child = self.context.Process(target=_serve, args=(theirs, self.place, self.work, self.weigh), daemon=True)
        self.child.start()
        theirs.close()

    def stop(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.link.close()
            self.child = None

    def _some(self, items: list[tuple]) -> Iterator[tuple]:
        """Answers to the first of ``items``, up to the one that ends the child, or to all."""
        if self.child is None:
            self.start()
        got, fault = 0, None
        self.place[0], self.place[1] = 0, time.monotonic()
        try:
            self.link.send(items)
            while got < len(items):
                at = int(self.place[0])
                # Between two items the child has no time to keep.
                left = self.place[1] + self.seconds - time.monotonic() if at >= got else self.seconds
                if self.link.poll(min(max(0.0, left), 0.01 if at < got else self.seconds)):
                    some = self.link.recv()
                    got += len(some)
                    yield from some
                elif left <= 0:
                    fault = TimedOut()
                    break
        except (EOFError, OSError) as e:
            fault = Died()
            fault.__cause__ = e
        if fault is not None:
            at = max(got, int(self.place[0]))
            self.stop()
            # What the child had done but not sent is done again.
            yield from self.answers(items[got:at])
            yield False, fault

    def answers(self, items: list[tuple]) -> Iterator[tuple]:
        """For each of ``items``, in order, (True, answer), or (False, the exception that it ended in)."""
        done = 0
        while done < len(items):
            for answer in self._some(items[done:]):
                done += 1
                yield answer

    def __call__(self, *item):
        ((done, answer),) = self.answers([item])
        if not done:
            raise answer
        return answer

    def __enter__(self) -> Timed:
        return self

    def __exit__(self, *_) -> None:
        self.stop()
