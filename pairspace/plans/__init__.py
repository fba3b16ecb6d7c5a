"""Plan-level helpers shared by the operators, and the chained mining plan."""
