"""Dawnframe: keyed series, signals, news and registry analytics as Spark DataFrame operators."""
