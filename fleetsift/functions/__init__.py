"""Column-level building blocks: matchers, addresses, time and text helpers."""
