"""A traceable recipe of shaping steps, fitted on the training part alone."""

from specula.operators.shaping.recipe import Cycle, Geometry, Partition, Shaped, Step, check, preset, run

__all__ = ["Cycle", "Geometry", "Partition", "Shaped", "Step", "check", "preset", "run"]
