"""The engine's operators on plain DataFrames.

Each is a composition of DataFrame operations and can be used by itself; the
planner uses the same ones on step frames.
"""
