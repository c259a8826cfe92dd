"""Jobs that read and write tables by plain paths, each with a command line and a config file."""
