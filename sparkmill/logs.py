"""The engine's log: its level and folder come from the environment, one file a day."""

from __future__ import annotations

import logging
import logging.handlers
import os
import time

NAME = "sparkmill"
LEVELS = {"trace": logging.DEBUG, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL, "off": logging.CRITICAL + 1}


def logger() -> logging.Logger:
    """The logger, set up on the first call by ``SPARKMILL_LOG_LEVEL`` (info) and ``SPARKMILL_LOG_DIR`` (no file without it)."""
    log = logging.getLogger(NAME)
    if not getattr(log, "_ready", False):
        log.setLevel(LEVELS[os.environ.get("SPARKMILL_LOG_LEVEL", "info").lower()])
        if folder := os.environ.get("SPARKMILL_LOG_DIR"):
            os.makedirs(folder, exist_ok=True)
            handler = logging.handlers.TimedRotatingFileHandler(os.path.join(folder, f"{NAME}.log"), when="midnight", utc=True)
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            handler.formatter.converter = time.gmtime
            log.addHandler(handler)
            log.propagate = False
        log._ready = True
    return log
