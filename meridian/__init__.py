"""Meridian: causal-graph robustness analytics over populations of graphs, on PySpark."""
