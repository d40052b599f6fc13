"""The engine and what is built on it: federation, memory, tools, questions, briefings."""
