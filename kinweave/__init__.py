"""Sequence-conservation analytics as Spark DataFrames: shared elements, their places, their order, and measures of assemblies."""

from .params import Params

__all__ = ["Params"]
