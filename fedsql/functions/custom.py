"""Classes that a script's own functions may be written as.

An aggregate's state begins as None.  ``Aggregate`` and ``WindowAggregate`` give their last state,
``StateAggregate`` and ``WindowStateAggregate`` what ``final_value`` makes of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType
from typing import Any


class Calculater:
    """A scalar function: ``calculate`` is called with the arguments."""

    def calculate(self, *args: Any) -> Any:
        raise NotImplementedError


class Aggregate:
    def aggregate(self, state: Any, value: Any) -> Any:
        """The state with one more value; the sum, if not said otherwise."""
        return state if value is None else value if state is None else state + value

    def reduce(self, state: Any, other: Any) -> Any:
        """Of two states."""
        return state if other is None else other if state is None else state + other


class StateAggregate(Aggregate):
    def final_value(self, state: Any) -> Any:
        return state


@dataclass
class Context:
    """Where a window function stands."""

    current_index: int
    datas: list


class WindowAggregate:
    def aggregate(self, state: Any, value: Any, context: Context) -> Any:
        raise ValueError("the window needs an order")

    def order_aggregate(self, state: Any, value: Any, context: Context) -> Any:
        return context.current_index + 1


class WindowStateAggregate(WindowAggregate):
    def final_value(self, state: Any) -> Any:
        return state


def made(x: Any, name: str) -> Any:
    """An instance of a class, made with the function's name if it asks for one."""
    if not isinstance(x, type):
        return x
    try:
        return x()
    except TypeError:
        return x(name)


def scalar_of(x: Any, name: str) -> Callable:
    """The function of a class, an object or a function."""
    x = made(x, name)
    return x.calculate if hasattr(x, "calculate") else x


def fold_of(x: Any, name: str) -> Callable[[list], Any]:
    """A function of a group's values from a class with ``aggregate``, or the function itself."""
    x = made(x, name)
    if not hasattr(x, "aggregate"):
        return x

    def fold(values: list) -> Any:
        state = None
        for v in values:
            state = x.aggregate(state, v)
        return x.final_value(state) if hasattr(x, "final_value") else state

    return fold


def window_fold_of(x: Any, name: str) -> Callable[[list], Any]:
    """A function of the values up to a row from a class with ``order_aggregate``, or the function itself."""
    x = made(x, name)
    if not hasattr(x, "order_aggregate"):
        return fold_of(x, name)

    def fold(values: list) -> Any:
        state = None
        for k, v in enumerate(values):
            state = x.order_aggregate(state, v, Context(k, values[: k + 1]))
        return x.final_value(state) if hasattr(x, "final_value") else state

    return fold


def is_module(x: Any) -> bool:
    return isinstance(x, ModuleType)
