"""wattlens: loss detection on electricity meter readings, as Spark DataFrame operators."""
