"""Generated workloads."""
