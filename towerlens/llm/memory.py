"""Giving memory back between batches, as workers of several stages live side by side, and the
check of a table's size before it is broadcast."""

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import functions as F

# Rows of a few numbers and a name each, so some megabytes.
BROADCAST_ROWS = 100_000


def release():
    """Return what Arrow and the C library keep for later use to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def kept(kind, key, make):
    """An object that a worker keeps from task to task. It keeps one: another one takes its place,
    whatever its kind, as the work of the former is over."""
    state = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if getattr(state, "name", None) != (kind, key):
        drop_kept()
        state.value, state.name = make(), (kind, key)
    return state.value


def drop_kept():
    """Give back what a worker kept; tasks that keep nothing call it when they begin."""
    state = sys.modules.get("_kept_by_worker")
    if state is not None and getattr(state, "name", None) is not None:
        state.name = state.value = None
        release()


def checked(frame, rows):
    """``frame``, whose number of rows is known, to be broadcast if that is small, and to be shuffled
    otherwise."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame
