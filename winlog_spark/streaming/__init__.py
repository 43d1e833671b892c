"""The stateless operators, and the failed-logon burst, on event streams."""
