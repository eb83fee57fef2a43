"""Jobs: runnable pipelines over tables, each a function that takes a session, and a command line around it."""
