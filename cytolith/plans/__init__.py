"""Multi-step commands, and the registered queries."""
