"""Registered queries over the driver tables, each with its oracle where SQL can express one."""
