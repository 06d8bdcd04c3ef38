"""Scalar column functions: cleaning, detection, CSS values, URLs and origins. All run inside the JVM."""
