"""Tables, files and the shared folder."""
