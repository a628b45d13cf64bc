"""Driver-side logging: extra levels, formats, JSON records and log files."""

from __future__ import annotations

import contextlib
import json
import logging
import sys
import traceback
from collections.abc import Iterator

#: The extra levels.
SUBPROC, REPORT, TIP, SUBPROC_ERR = 14, 19, 21, 41
LEVELS = {"SUBPROC": SUBPROC, "REPORT": REPORT, "TIP": TIP, "SUBPROC_ERR": SUBPROC_ERR}
for _name, _level in LEVELS.items():
    logging.addLevelName(_level, _name)

FANCY, BASIC, JSON = "fancy", "basic", "json"
_COLOURS = {logging.DEBUG: 90, SUBPROC: 36, REPORT: 32, logging.INFO: 37, TIP: 34, logging.WARNING: 33, logging.ERROR: 31, SUBPROC_ERR: 35, logging.CRITICAL: 41}
_failures: list[str] = []


class ModelLogger(logging.Logger):
    def report(self, msg: str, *args: object, **kw: object) -> None:
        self.log(REPORT, msg, *args, **kw)

    def tip(self, msg: str, *args: object, **kw: object) -> None:
        self.log(TIP, msg, *args, **kw)

    def subproc_message(self, msg: str, *args: object, **kw: object) -> None:
        self.log(SUBPROC, msg, *args, **kw)

    def subproc_err(self, msg: str, *args: object, **kw: object) -> None:
        self.log(SUBPROC_ERR, msg, *args, **kw)

    def log_json(self, text: str) -> None:
        """Handles a JSON record that another process wrote."""
        self.handle(logging.makeLogRecord(json.loads(text)))

    def load_failure(self, what: str) -> None:
        _failures.append(what)
        self.warning("could not load %s", what)

    def flush_load_failures(self) -> list[str]:
        out, _failures[:] = list(_failures), []
        for x in out:
            self.warning("not loaded: %s", x)
        return out


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"levelname": record.levelname, "name": record.name, "msg": record.getMessage(), "created": record.created, "levelno": record.levelno, "asctime": self.formatTime(record)})


class FancyFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\x1b[{_COLOURS.get(record.levelno, 37)}m{super().format(record)}\x1b[0m"


class RangeFilter(logging.Filter):
    def __init__(self, low: int, high: int):
        super().__init__()
        self.low, self.high = low, high

    def filter(self, record: logging.LogRecord) -> bool:
        return self.low <= record.levelno <= self.high


def formatter(style: str) -> logging.Formatter:
    if style == JSON:
        return JsonFormatter()
    plain = "%(asctime)s %(levelname)s %(name)s: %(message)s"
    return FancyFormatter(plain) if style == FANCY else logging.Formatter(plain if style == BASIC else style)


def get_model_logger(name: str) -> ModelLogger:
    before = logging.getLoggerClass()
    logging.setLoggerClass(ModelLogger)
    try:
        return logging.getLogger(name)  # type: ignore[return-value]
    finally:
        logging.setLoggerClass(before)


def init_root(name: str, *, style: str = BASIC, level: int = logging.DEBUG) -> ModelLogger:
    """A root for a model's loggers: up to warnings to stdout, worse to stderr."""
    root = get_model_logger(name)
    root.setLevel(level)
    root.propagate = False
    root.handlers.clear()
    for stream, low, high in ((sys.stdout, 0, logging.WARNING), (sys.stderr, logging.WARNING + 1, 1000)):
        handler = logging.StreamHandler(stream)
        handler.addFilter(RangeFilter(low, high))
        handler.setFormatter(formatter(style))
        root.addHandler(handler)
    return root


@contextlib.contextmanager
def log_to_file(path: str, name: str, *, append: bool = False, style: str = BASIC) -> Iterator[ModelLogger]:
    """Also logs to a file; an exception's traceback goes there before it is raised again."""
    logger = get_model_logger(name)
    handler = logging.FileHandler(path, "a" if append else "w", encoding="utf-8")
    handler.setFormatter(formatter(style))
    logger.addHandler(handler)
    try:
        yield logger
    except BaseException:
        handler.stream.write(traceback.format_exc())
        raise
    finally:
        logger.removeHandler(handler)
        handler.close()
