"""Written tables, stores of run positions and the state codec."""
