"""Layers around searches and writes: retrying, caching, logging, measuring, time limits; events and named parts.

A layer takes a function and returns one that is called alike, so ``chain`` composes any of them. What is cached or
measured are the calls on the driver; DataFrames themselves stay lazy.
"""

from __future__ import annotations

import functools
import logging
import threading
import time
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Layer = Callable[[Callable], Callable]


def chain(fn: Callable, *layers: Layer) -> Callable:
    """``fn`` inside the layers, the first outermost."""
    return functools.reduce(lambda inner, layer: layer(inner), reversed(layers), fn)


def retrying(tries: int = 3, wait: float = 0.1, factor: float = 2.0, errors: tuple[type[BaseException], ...] = (OSError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> Layer:
    """Calls again after one of ``errors``, waiting longer each time; the last error is raised."""

    def layer(fn):
        @functools.wraps(fn)
        def run(*args, **options):
            for k in range(tries):
                try:
                    return fn(*args, **options)
                except errors:
                    if k == tries - 1:
                        raise
                    sleep(wait * factor**k)

        return run

    return layer


def cached(size: int = 128, seconds: float | None = None, key: Callable = lambda *a, **o: (a, tuple(sorted(o.items()))), clock: Callable[[], float] = time.monotonic) -> Layer:
    """Keeps the last ``size`` answers for ``seconds``; ``key`` of the call must be hashable. The function has ``clear()``."""

    def layer(fn):
        held: OrderedDict = OrderedDict()

        @functools.wraps(fn)
        def run(*args, **options):
            k = key(*args, **options)
            if k in held and (seconds is None or clock() - held[k][0] < seconds):
                held.move_to_end(k)
                return held[k][1]
            out = fn(*args, **options)
            held[k] = (clock(), out)
            held.move_to_end(k)
            while len(held) > size:
                held.popitem(last=False)
            return out

        run.clear = held.clear
        return run

    return layer


def logged(logger: logging.Logger | None = None, level: int = logging.INFO) -> Layer:
    """A line for each call: name, seconds, and the error if there was one."""
    to = logger or logging.getLogger("quarry")

    def layer(fn):
        @functools.wraps(fn)
        def run(*args, **options):
            began = time.perf_counter()
            try:
                out = fn(*args, **options)
            except Exception as e:
                to.log(max(level, logging.WARNING), "%s failed after %.3f s: %s", fn.__name__, time.perf_counter() - began, e)
                raise
            to.log(level, "%s took %.3f s", fn.__name__, time.perf_counter() - began)
            return out

        return run

    return layer


@dataclass
class Metrics:
    """Calls, errors and seconds by name."""

    calls: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    errors: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    seconds: dict[str, float] = field(default_factory=lambda: defaultdict(float))

    def layer(self, name: str) -> Layer:
        def layer(fn):
            @functools.wraps(fn)
            def run(*args, **options):
                began = time.perf_counter()
                self.calls[name] += 1
                try:
                    return fn(*args, **options)
                except Exception:
                    self.errors[name] += 1
                    raise
                finally:
                    self.seconds[name] += time.perf_counter() - began

            return run

        return layer

    def text(self, prefix: str = "quarry") -> str:
        """The figures in the text format that metric collectors read."""
        rows = []
        for kind, values in (("calls_total", self.calls), ("errors_total", self.errors), ("seconds_total", self.seconds)):
            rows += [f"# TYPE {prefix}_{kind} counter", *(f'{prefix}_{kind}{{name="{n}"}} {v}' for n, v in sorted(values.items()))]
        return "\n".join(rows) + "\n"


class TimeLimit(RuntimeError):
    """An action that took longer than it was given; its jobs were cancelled."""


def within(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """What ``action`` returns, if its Spark jobs end in time; else they are cancelled and TimeLimit is raised."""
    tag, over, done = f"quarry-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        if done.wait(seconds):
            return
        over.set()
        while not done.wait(0.1):  # a job that is still being planned is cancelled once it runs
            spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watch = threading.Thread(target=stop, daemon=True)
    watch.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise TimeLimit(f"over {seconds} s") from e
        raise
    finally:
        done.set()
        watch.join()
        spark.sparkContext.removeJobTag(tag)


class Events:
    """Named events: ``on`` registers a function, ``emit`` calls them in the order of registration. The name "*" hears all."""

    def __init__(self):
        self.heard: dict[str, list[Callable]] = defaultdict(list)

    def on(self, name: str, fn: Callable) -> Callable[[], None]:
        """Registers ``fn``; what is returned takes it back."""
        self.heard[name].append(fn)
        return lambda: self.heard[name].remove(fn)

    def emit(self, name: str, **facts) -> list:
        return [fn(**facts) for fn in list(self.heard[name])] + [fn(name=name, **facts) for fn in list(self.heard["*"])]


class Registry:
    """Makers by name, for analyzers, sources, models and the like; a name is given once unless ``replace`` says so."""

    def __init__(self, makers: Mapping[str, Callable] | None = None):
        self.makers: dict[str, Callable] = dict(makers or {})

    def register(self, name: str, maker: Callable | None = None, replace: bool = False):
        if maker is None:
            return lambda fn: self.register(name, fn, replace) or fn
        if name in self.makers and not replace:
            raise ValueError(f"{name!r} is taken")
        self.makers[name] = maker

    def make(self, name: str, *args, **options):
        if name not in self.makers:
            raise KeyError(f"{name!r} is not one of {sorted(self.makers)}")
        return self.makers[name](*args, **options)

    def names(self) -> list[str]:
        return sorted(self.makers)

    def load(self, group: str) -> list[str]:
        """Registers what installed packages offer under an entry-point group; returns the names."""
        from importlib.metadata import entry_points

        found = [e for e in entry_points(group=group) if e.name not in self.makers]
        for e in found:
            self.register(e.name, e.load())
        return [e.name for e in found]


class Plugins:
    """Plug-ins: objects with any of the methods ``before_index(df)``, ``rewrite(query)``, ``after_search(df)``, applied in order."""

    def __init__(self, *plugins):
        self.plugins = list(plugins)

    def add(self, plugin) -> None:
        self.plugins.append(plugin)

    def _each(self, method: str, value):
        for p in self.plugins:
            if (fn := getattr(p, method, None)) is not None:
                value = fn(value)
        return value

    def before_index(self, df: DataFrame) -> DataFrame:
        return self._each("before_index", df)

    def rewrite(self, query):
        return self._each("rewrite", query)

    def after_search(self, df: DataFrame) -> DataFrame:
        return self._each("after_search", df)
