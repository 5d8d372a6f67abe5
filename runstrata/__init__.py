"""Content-addressed archives of file trees and event logs, queried with Spark."""
