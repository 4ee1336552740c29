"""Scalar functions: Column in, Column out, all inside Catalyst."""
