"""Log to the console and to a file that rotates."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler

# Size at which a log file rotates, and how many are kept.
FILE_BYTES, FILES = 10 * 1024 * 1024, 5


def set_up_logging(folder: str | None = None, level: str = "INFO", name: str = "filmloom") -> logging.Logger:
    """The package's logger with a console handler and, with a folder, a rotating file; calling again adds nothing."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    style = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    wanted: list[logging.Handler] = []
    if not any(type(h) is logging.StreamHandler for h in logger.handlers):
        wanted.append(logging.StreamHandler())
    if folder and not any(isinstance(h, RotatingFileHandler) for h in logger.handlers):
        os.makedirs(folder, exist_ok=True)
        wanted.append(RotatingFileHandler(f"{folder}/{name}.log", maxBytes=FILE_BYTES, backupCount=FILES, encoding="utf-8"))
    for handler in wanted:
        handler.setFormatter(style)
        logger.addHandler(handler)
    return logger
